"""Live views as set-based aggregates over the deduplicated change log.

The sums are associative and keyed, so they do not depend on the order in which
changes arrive, and applying a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.functions.scalars import business_date
from storelens.operators import cdc
from storelens.sources import inputs
from storelens.sources.inputs import Source

LOW_STOCK = 10
#: Hours that a live view's rows are kept.
RETENTION_HOURS = {"funnel": 6, "day": 3 * 24, "seen": 7 * 24}


def order_log(spark: SparkSession, sf_dir: Source) -> DataFrame:
    log = cdc.changes(inputs.of(sf_dir).order_changes(spark))
    return log.withColumns({"previous_status": cdc.previous_status(log), "day": business_date(F.col("changed_at"))})


def status_board(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """Orders now in each status."""
    return cdc.signed_board(order_log(spark, sf_dir)).where("orders <> 0")


def day_kpis(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """New orders, their revenue and cancellations by the day of the change."""
    new = F.col("op") == "c"
    cancelled = (F.col("op") == "u") & (F.col("status") == "CANCELLED")
    return (
        order_log(spark, sf_dir)
        .where(new | cancelled)
        .groupBy("day")
        .agg(F.count_if(new).alias("orders"), F.coalesce(F.sum(F.when(new, F.col("order_total"))), F.lit(0)).cast("double").alias("revenue"), F.count_if(cancelled).alias("cancelled"))
    )


def recent_orders(spark: SparkSession, sf_dir: Source, limit: int = 20) -> DataFrame:
    """The orders created last, 1 to 20 of them."""
    if not 1 <= limit <= 20:
        raise ValueError(f"{limit} is not within 1 to 20")
    new = order_log(spark, sf_dir).where("op = 'c'")
    return new.orderBy(F.desc("ts_ms"), F.desc("kafka_offset")).limit(limit).select("order_id", "customer_id", F.col("order_total").cast("double").alias("order_total"), "ship_province", "payment_method", "placed_at", "ts_ms")


def product_days(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """Units and revenue of new lines by day and product."""
    log = cdc.changes(inputs.of(sf_dir).order_item_changes(spark)).where("op = 'c'")
    return log.groupBy(business_date(F.col("changed_at")).alias("day"), "product_id").agg(F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("unit_price")).cast("double").alias("revenue"))


def top_products(spark: SparkSession, sf_dir: Source, by: str = "revenue", limit: int = 3) -> DataFrame:
    """The best sellers of each day; ties go to the larger id as text, as a sorted set read backwards does."""
    return ranked_products(product_days(spark, sf_dir), by, limit)


def ranked_products(days: DataFrame, by: str = "revenue", limit: int = 3) -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.desc(by), F.col("product_id").cast("string").desc())
    return days.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def low_stock(spark: SparkSession, sf_dir: Source, threshold: int = LOW_STOCK) -> DataFrame:
    """Products whose last stock is at or under one threshold for all."""
    return cdc.live(cdc.changes(inputs.of(sf_dir).inventory_changes(spark)), "product_id").where(F.col("stock_on_hand") <= threshold).select("product_id", "stock_on_hand")


def display_names(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """The last image of products and customers that is no deletion; a deleted one keeps its name."""
    products = product_cards(spark, sf_dir).select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), F.col("product_name").alias("name"))
    customers = customer_cards(spark, sf_dir).select(F.lit("customer").alias("kind"), F.col("customer_id").alias("id"), F.col("first_name").alias("name"))
    return products.unionByName(customers)


def product_cards(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """Name, category and price of every product; of changes in one instant with one offset, the dearest."""
    log = inputs.of(sf_dir).product_changes(spark).where("op <> 'd'")
    last = log.groupBy("product_id").agg(F.max_by(F.struct("product_name", "category", "price", "ts_ms"), F.struct("ts_ms", "kafka_offset", "price")).alias("r"))
    return last.select("product_id", "r.*")


def customer_cards(spark: SparkSession, sf_dir: Source) -> DataFrame:
    """Name, province and city of every customer."""
    return cdc.latest(inputs.of(sf_dir).customer_changes(spark).where("op <> 'd'"), "customer_id", keep=["first_name", "province", "city"])


def retained(view: DataFrame, column: str, now: str, kind: str) -> DataFrame:
    """The rows of a live view that have not expired: funnel cells after 6 hours, day views after 3 days, guards after 7."""
    return view.where(F.col(column) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(RETENTION_HOURS[kind])))


def alerts_by_day(carts: DataFrame) -> DataFrame:
    """Abandoned carts by the day of their last activity; a session counts once, ever."""
    once = carts.groupBy("session_id").agg(F.min_by(F.struct("last_activity_at", "cart_value"), "last_activity_at").alias("a"))
    return once.groupBy(business_date(F.col("a.last_activity_at")).alias("day")).agg(F.count("*").alias("alerts"), F.sum(F.col("a.cart_value").cast("decimal(18,2)")).cast("double").alias("value"))
