"""The store's inputs as the plans take them: logs, clicks and partner rows, wherever they come from.

A plan takes the folder of tables, or one of these.  ``Tables`` derives all
inputs from the TPC-H-like tables; ``Landed`` reads what the streams have landed,
and takes from another what no stream lands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators import cdc
from storelens.sources import adapters


class Tables:
    """Inputs by the adapters' rules."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def clicks(self, spark: SparkSession, repeated: bool = False) -> DataFrame:
        return adapters.clicks(spark, self.sf_dir, repeated)

    def order_changes(self, spark: SparkSession) -> DataFrame:
        """An order's changes lie together, so what is made of them by order is not moved again."""
        return adapters.order_changes(spark, self.sf_dir, together=True, tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def order_item_changes(self, spark: SparkSession, together: bool = False) -> DataFrame:
        """together: all changes of an order's lines are to lie in one partition, where inputs can have them so."""
        return adapters.order_item_changes(spark, self.sf_dir, together)

    def product_changes(self, spark: SparkSession) -> DataFrame:
        return adapters.product_changes(spark, self.sf_dir)

    def price_changes(self, spark: SparkSession) -> DataFrame:
        """Changes of products, without what product_names holds."""
        return adapters.price_changes(spark, self.sf_dir)

    def product_names(self, spark: SparkSession) -> DataFrame | None:
        """What never changes of a product, a row for each; None where changes hold all of it."""
        return adapters.product_names(spark, self.sf_dir)

    def busy_products(self, spark: SparkSession, more_than: int) -> DataFrame:
        """Products with more changes than so many; more may be named."""
        return adapters.busy_products(spark, self.sf_dir, more_than)

    def customer_changes(self, spark: SparkSession) -> DataFrame:
        return adapters.customer_changes(spark, self.sf_dir)

    def inventory_changes(self, spark: SparkSession) -> DataFrame:
        return adapters.inventory_changes(spark, self.sf_dir)

    def deliveries_raw(self, spark: SparkSession) -> DataFrame:
        return adapters.deliveries_raw(spark, self.sf_dir)

    def first_order(self, spark: SparkSession) -> DataFrame:
        """One row: the day of the first order."""
        return adapters.table(spark, self.sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("first"))


class Landed(Tables):
    """Changes from a landed log of parsed messages, each once; all else from other inputs."""

    def __init__(self, changes: Callable[[SparkSession], DataFrame], other: Source):
        self.changes, self.other = changes, of(other)

    def _typed(self, spark: SparkSession, table: str) -> DataFrame:
        return cdc.typed(self.changes(spark), table).drop("previous_status")

    def order_changes(self, spark: SparkSession) -> DataFrame:
        return self._typed(spark, "orders")

    def order_item_changes(self, spark: SparkSession, together: bool = False) -> DataFrame:
        return self._typed(spark, "order_items")

    def product_changes(self, spark: SparkSession) -> DataFrame:
        """Places order a product's changes whole, so nothing else breaks ties."""
        return self._typed(spark, "products").withColumns({"_quantity": F.lit(0), "_supplier": F.lit(0)})

    def price_changes(self, spark: SparkSession) -> DataFrame:
        return self.product_changes(spark)

    def product_names(self, spark: SparkSession) -> None:
        return None

    def busy_products(self, spark: SparkSession, more_than: int) -> DataFrame:
        return self.product_changes(spark).groupBy("product_id").count().where((F.col("count") > more_than) & F.col("product_id").isNotNull()).select("product_id")

    def customer_changes(self, spark: SparkSession) -> DataFrame:
        return self._typed(spark, "customers")

    def inventory_changes(self, spark: SparkSession) -> DataFrame:
        return self._typed(spark, "inventory")

    def clicks(self, spark: SparkSession, repeated: bool = False) -> DataFrame:
        return self.other.clicks(spark, repeated)

    def deliveries_raw(self, spark: SparkSession) -> DataFrame:
        return self.other.deliveries_raw(spark)

    def first_order(self, spark: SparkSession) -> DataFrame:
        return self.order_changes(spark).agg(F.min("placed_at").cast("date").alias("first"))


class Arrived(Tables):
    """Other inputs' changes and deliveries as far as they have arrived, by a condition on each."""

    def __init__(self, other: Source, changes: Column, deliveries: Column):
        self.other, self.changes, self.deliveries = of(other), changes, deliveries

    def clicks(self, spark: SparkSession, repeated: bool = False) -> DataFrame:
        return self.other.clicks(spark, repeated)

    def order_changes(self, spark: SparkSession) -> DataFrame:
        return self.other.order_changes(spark).where(self.changes)

    def order_item_changes(self, spark: SparkSession, together: bool = False) -> DataFrame:
        return self.other.order_item_changes(spark, together).where(self.changes)

    def product_changes(self, spark: SparkSession) -> DataFrame:
        return self.other.product_changes(spark).where(self.changes)

    def price_changes(self, spark: SparkSession) -> DataFrame:
        return self.other.price_changes(spark).where(self.changes)

    def product_names(self, spark: SparkSession) -> DataFrame | None:
        return self.other.product_names(spark)

    def busy_products(self, spark: SparkSession, more_than: int) -> DataFrame:
        return self.other.busy_products(spark, more_than)

    def customer_changes(self, spark: SparkSession) -> DataFrame:
        return self.other.customer_changes(spark).where(self.changes)

    def inventory_changes(self, spark: SparkSession) -> DataFrame:
        return self.other.inventory_changes(spark).where(self.changes)

    def deliveries_raw(self, spark: SparkSession) -> DataFrame:
        return self.other.deliveries_raw(spark).where(self.deliveries)

    def first_order(self, spark: SparkSession) -> DataFrame:
        return self.order_changes(spark).agg(F.min("placed_at").cast("date").alias("first"))


class Only(Tables):
    """Other inputs cut to some keys: each a table with one row for each of its keys, or all keys where it is not given."""

    def __init__(self, other: Source, orders: DataFrame | None = None, customers: DataFrame | None = None, products: DataFrame | None = None):
        self.other, self.orders, self.customers, self.products = of(other), orders, customers, products

    @staticmethod
    def _cut(log: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
        return log if keys is None else log.join(keys, key, "left_semi")

    def clicks(self, spark: SparkSession, repeated: bool = False) -> DataFrame:
        return self.other.clicks(spark, repeated)

    def order_changes(self, spark: SparkSession) -> DataFrame:
        return self._cut(self.other.order_changes(spark), self.orders, "order_id")

    def order_item_changes(self, spark: SparkSession, together: bool = False) -> DataFrame:
        return self._cut(self.other.order_item_changes(spark, together), self.orders, "order_id")

    def product_changes(self, spark: SparkSession) -> DataFrame:
        return self._cut(self.other.product_changes(spark), self.products, "product_id")

    def price_changes(self, spark: SparkSession) -> DataFrame:
        return self._cut(self.other.price_changes(spark), self.products, "product_id")

    def product_names(self, spark: SparkSession) -> DataFrame | None:
        return self.other.product_names(spark)

    def busy_products(self, spark: SparkSession, more_than: int) -> DataFrame:
        return self.other.busy_products(spark, more_than)

    def customer_changes(self, spark: SparkSession) -> DataFrame:
        return self._cut(self.other.customer_changes(spark), self.customers, "customer_id")

    def inventory_changes(self, spark: SparkSession) -> DataFrame:
        return self._cut(self.other.inventory_changes(spark), self.products, "product_id")

    def deliveries_raw(self, spark: SparkSession) -> DataFrame:
        """All rows of the waybills that the orders have: rows of a waybill displace one another."""
        raw = self.other.deliveries_raw(spark)
        if self.orders is None:
            return raw
        of_orders = raw.select(F.trim("waybill").alias("_bill"), F.trim("order_id").try_cast("long").alias("order_id")).join(self.orders, "order_id", "left_semi")
        return raw.join(of_orders.select("_bill").distinct(), F.trim("waybill") == F.col("_bill"), "left_semi")

    def first_order(self, spark: SparkSession) -> DataFrame:
        return self.other.first_order(spark)


#: What a plan takes: a folder of tables, or inputs.
Source = str | Tables


def of(source: Source) -> Tables:
    return Tables(source) if isinstance(source, str) else source
