"""Keeps published order tables up to date by what a delivery brings, instead of rebuilding them.

The tables are divided: dimensions by a hash of their key, facts by day (or by
month, where days are small), sales by month.  Tables that are read by key lie by a
hash of it, in sorted files, so a read by key opens one bucket and no log.  A delivery of changes and partner rows touches keys: orders that it names
or whose waybills it names, and orders of customers and products of which it brings
a version, from that version's time on.  The rows of these orders are computed
anew, from the logs cut to them, and replace theirs in the parts that they lie in
or lay in before; no other part is written.  All tables become visible in one
snapshot.

What a refresh leaves equals a rebuild over all that has arrived, in whatever
order.  A delivery that comes again changes nothing, so a crash at any step is
repaired by a repetition.  Touched keys are written before they are joined, so the
planner knows their size and broadcasts them only where it is small.  To the driver
come the names of touched parts: buckets, days and months.

Where a delivery touches more than one key in eight, cutting the logs to them
would move as much as the logs hold; the table is then made anew instead, with
the same result.  Tables that are made from facts are read from the new facts.

Scores of customers are ranks among all of them, so their table is made anew from
the published facts.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import surrogate_key
from storelens.operators import cdc, snapshots
from storelens.operators.snapshots import NO_PART, Parts, Snapshot, part_name
from storelens.plans import marts
from storelens.sources import files, inputs
from storelens.sources.inputs import Only, Source

BUCKETS = 64
#: A delivery that touches more than one in so many keys has the table made anew.
REBUILT_FROM = 8


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


#: By what facts can be divided; a day's name begins with its month's.
FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def layout(by: str = "day") -> dict[str, Column]:
    """How each table is divided."""
    day = F.date_format("order_date", FORMATS[by])
    return {"dim_customers": _bucket("customer_id"), "dim_products": _bucket("product_id"), "fct_orders": day, "fct_order_items": day, "customer_orders": _bucket("customer_id"), "customer_rfm": _bucket("customer_id"), "sales_daily": F.date_format("order_date", FORMATS["month"])}


def _derived(name: str) -> dict[str, Column]:
    """Surrogate keys of dimensions: they do not compress, and follow from key and version."""
    key = {"dim_customers": "customer", "dim_products": "product"}.get(name)
    return {f"{key}_sk": surrogate_key(F.col(f"{key}_id"), F.col("version"))} if key else {}


#: Facts that move as what they are made from: the rows, the columns that follow from them, and the table's columns.
FROM_VERSIONS = {"fct_orders": (marts.versioned_orders, marts.order_keys, marts.ORDER_COLUMNS), "fct_order_items": (marts.versioned_items, marts.item_keys, marts.ITEM_COLUMNS)}


def _anew(spark: SparkSession, source: Source, name: str, part: Column) -> Parts:
    """All parts of a table that is made from the inputs."""
    if name not in FROM_VERSIONS:
        return Parts(MAKERS[name](spark, source), part, sort=SORTED.get(name), derived=_derived(name))
    rows, derived, columns = FROM_VERSIONS[name]
    return Parts(rows(spark, source), part, derived=derived(), columns=columns)


def customer_orders(spark: SparkSession, source: Source) -> DataFrame:
    return _orders_of(marts.fct_orders(spark, source))


def _orders_of(facts: DataFrame) -> DataFrame:
    """What is shown of a customer's orders; a copy of these columns that lies by customer."""
    return facts.select("order_id", "customer_id", "placed_at", "status", "order_total", "courier", "delivery_hours")


#: By what the files of tables that are read by key are sorted.
SORTED = {"dim_customers": "customer_id", "dim_products": "product_id", "customer_orders": "customer_id", "customer_rfm": "customer_id"}
MAKERS = {"dim_customers": marts.dim_customers, "dim_products": marts.dim_products, "fct_orders": marts.fct_orders, "fct_order_items": marts.fct_order_items, "customer_orders": customer_orders, "sales_daily": marts.sales_daily}
TABLES = (*MAKERS, "customer_rfm")
#: Tables from whose parts another one is made.
NEEDS = {"customer_orders": {"fct_orders"}, "sales_daily": {"fct_orders"}, "customer_rfm": {"fct_orders", "dim_customers"}}


def _wanted(names: Collection[str]) -> set[str]:
    return set(names).union(*(NEEDS.get(n, set()) for n in names))


def build(spark: SparkSession, source: Source, warehouse: str, names: Collection[str] = TABLES, as_of: str = marts.AS_OF, by: str = "day") -> int:
    """The first snapshot: all parts of the tables, and of those that they are made from; a refresh divides facts likewise."""
    parts, wanted = layout(by), _wanted(names)
    made: dict[str, snapshots.Made] = {name: _anew(spark, source, name, parts[name]) for name in sorted(wanted) if name not in NEEDS}
    if "customer_orders" in wanted:
        made["customer_orders"] = lambda new: Parts(_orders_of(new.read("fct_orders")), parts["customer_orders"], sort=SORTED["customer_orders"])
    if "sales_daily" in wanted:
        made["sales_daily"] = lambda new: Parts(marts.sales_of(new.read("fct_orders"), marts.sales_days(spark, source, as_of)), parts["sales_daily"])
    if "customer_rfm" in wanted:
        made["customer_rfm"] = lambda new: _scores(new, as_of)
    return snapshots.commit(spark, warehouse, made)


def _scores(new: Snapshot, as_of: str) -> Parts:
    return Parts(marts.rfm_of(new.read("fct_orders"), new.read("dim_customers"), as_of), layout()["customer_rfm"], sort=SORTED["customer_rfm"])


def of_key(snapshot: Snapshot, name: str, key: int) -> DataFrame:
    """A key's rows of a table that lies by key: one bucket is listed and opened."""
    (bucket,) = snapshot.spark.range(1).select(_bucket(F.lit(key).cast("long"))).first()
    return snapshot.read(name, [str(bucket)]).where(F.col(SORTED[name]) == key)


def _since(log: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """(key, since): from when on a key's versions differ; null where no older change is there and all of them do."""
    new = cdc.changes(delivered).groupBy(key).agg(F.min("changed_at").alias("_new"))
    first = cdc.changes(log).groupBy(key).agg(F.min("changed_at").alias("_first"))
    return new.join(first, key).select(key, F.when(F.col("_first") < F.col("_new"), F.col("_new")).alias("since"))


def _billed(log: DataFrame, delivered: DataFrame) -> DataFrame:
    """Orders of the waybills that delivered rows name."""
    bills = delivered.select(F.trim("waybill").alias("_bill")).distinct()
    return log.join(bills, F.trim("waybill") == F.col("_bill"), "left_semi").select(F.trim("order_id").try_cast("long").alias("order_id")).where("order_id is not null")


def _divided_by(old: Snapshot) -> str:
    """How the facts of a snapshot are divided."""
    names = {len(p) for t in ("fct_orders", "fct_order_items") if t in old.tables for p in old.parts(t) if p != NO_PART}
    return "month" if names == {len("2000-01")} else "day"


def _replaced(old: Snapshot, name: str, rows: DataFrame, keys: DataFrame, key: str) -> Parts | None:
    """The parts in which keys lie or lay, with the keys' rows replaced; nothing where there are none."""
    part = layout(_divided_by(old))[name]
    names = lambda df: df.select(part_name(part).alias("part"))
    touched = sorted(r[0] for r in names(old.read(name).join(keys, key, "left_semi")).unionByName(names(rows)).distinct().collect())
    if not touched:
        return None
    return Parts(old.read(name, touched).join(keys, key, "left_anti").unionByName(rows), part, touched, SORTED.get(name))


def _most(keys: DataFrame, table: DataFrame, key: str) -> bool:
    """Whether keys, one row each, are so many of a table's that it is made anew."""
    return keys.count() * REBUILT_FROM > table.agg(F.approx_count_distinct(key)).first()[0]


def _sales(spark: SparkSession, source: Source, old: Snapshot, new: Snapshot, orders: Parts | None, as_of: str) -> Parts | None:
    """Months with touched days, or whose days the calendar has now and the table has not, or the other way."""
    calendar = marts.sales_days(spark, source, as_of)
    if orders is not None and orders.replaced is None:
        return Parts(marts.sales_of(new.read("fct_orders"), calendar), layout()["sales_daily"])
    there = old.read("sales_daily").select(F.col("order_date").alias("date_day"), F.lit(True).alias("_there"))
    other = calendar.select("date_day", F.lit(True).alias("_now")).join(there, "date_day", "full").where("_now is null or _there is null")
    months = {r[0] for r in other.select(F.date_format("date_day", "yyyy-MM")).distinct().collect()}
    months |= {day[:7] for day in (orders.replaced if orders else ()) if day != NO_PART}
    if not months:
        return None
    facts = new.read("fct_orders", [day for day in new.parts("fct_orders") if day[:7] in months])
    days = calendar.where(F.date_format("date_day", "yyyy-MM").isin(sorted(months)))
    return Parts(marts.sales_of(facts, days), layout()["sales_daily"], sorted(months))


def refresh(spark: SparkSession, source: Source, delivered: Source, warehouse: str, names: Collection[str] = TABLES, as_of: str = marts.AS_OF) -> int:
    """Brings published tables up to date and returns the snapshot's number.

    source: all that has arrived, the delivery included.  delivered: the delivery
    alone.  names: tables to refresh, together with those that they are made from.
    """
    whole, new, wanted = inputs.of(source), inputs.of(delivered), _wanted(names)
    old = Snapshot(spark, warehouse)
    work = f"{warehouse}/_work/{uuid.uuid4().hex}"

    def kept(name: str, rows: DataFrame) -> DataFrame:
        with files.shuffles_end_with_writes(spark):
            rows.write.option("compression", "zstd").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    made: dict[str, snapshots.Made | None] = {}
    parts = layout(_divided_by(old))

    try:
        if wanted & {"fct_orders", "fct_order_items"}:
            named = kept("named", new.order_changes(spark).select("order_id").unionByName(new.order_item_changes(spark).select("order_id")).distinct())
        most_orders = "fct_orders" in wanted and _most(named, old.read("fct_orders"), "order_id")
        if "dim_customers" in wanted or ("fct_orders" in wanted and not most_orders):
            customers = kept("customers", _since(whole.customer_changes(spark), new.customer_changes(spark), "customer_id"))
        if wanted & {"dim_products", "fct_order_items"}:
            changed = kept("changed", new.price_changes(spark).select("product_id").distinct())
            most = {t: _most(changed, old.read(t), "product_id") for t in ("dim_products", "fct_order_items") if t in wanted}
            if not all(most.values()):
                products = kept("products", _since(whole.price_changes(spark), new.price_changes(spark), "product_id"))
        if "dim_customers" in wanted:
            rows = kept("dim_customers", marts.dim_customers(spark, Only(whole, customers=customers)))
            made["dim_customers"] = _replaced(old, "dim_customers", rows, customers, "customer_id")
        if "dim_products" in wanted and most["dim_products"]:
            made["dim_products"] = _anew(spark, whole, "dim_products", parts["dim_products"])
        elif "dim_products" in wanted:
            ids = kept("stocked", products.select("product_id").unionByName(new.inventory_changes(spark).select("product_id")).distinct())
            rows = kept("dim_products", marts.dim_products(spark, Only(whole, products=ids)))
            made["dim_products"] = _replaced(old, "dim_products", rows, ids, "product_id")
        if most_orders:
            made["fct_orders"] = _anew(spark, whole, "fct_orders", parts["fct_orders"])
            if "customer_orders" in wanted:
                made["customer_orders"] = lambda s: Parts(_orders_of(s.read("fct_orders")), parts["customer_orders"], sort=SORTED["customer_orders"])
        elif "fct_orders" in wanted:
            dated = old.read("fct_orders").select("order_id", "customer_id", "placed_at").join(customers, "customer_id").where("since is null or placed_at >= since")
            orders = kept("orders", named.unionByName(_billed(whole.deliveries_raw(spark), new.deliveries_raw(spark))).unionByName(dated.select("order_id")).distinct())
            buyers = kept("buyers", Only(whole, orders=orders).order_changes(spark).select("customer_id").distinct())
            rows = kept("fct_orders", marts.fct_orders(spark, Only(whole, orders=orders, customers=buyers)))
            made["fct_orders"] = _replaced(old, "fct_orders", rows, orders, "order_id")
            if "customer_orders" in wanted:
                made["customer_orders"] = _replaced(old, "customer_orders", _orders_of(rows), orders, "order_id")
        if "fct_order_items" in wanted and (most["fct_order_items"] or _most(named, old.read("fct_order_items"), "order_id")):
            made["fct_order_items"] = _anew(spark, whole, "fct_order_items", parts["fct_order_items"])
        elif "fct_order_items" in wanted:
            # A day earlier, as a business day and the instant's own may differ by one.
            sold = old.read("fct_order_items").select("order_id", "product_id", "order_date").join(products, "product_id").where("since is null or order_date >= date_sub(cast(since as date), 1)")
            orders = kept("lined", named.unionByName(sold.select("order_id")).distinct())
            lines = kept("lines", marts.dated_lines(spark, Only(whole, orders=orders)))
            goods = kept("goods", lines.select("product_id").distinct())
            rows = kept("fct_order_items", marts.priced(spark, Only(whole, products=goods), lines))
            made["fct_order_items"] = _replaced(old, "fct_order_items", rows, orders, "order_id")
        if "sales_daily" in wanted:
            made["sales_daily"] = lambda s: _sales(spark, whole, old, s, made["fct_orders"], as_of)
        if "customer_rfm" in wanted:
            made["customer_rfm"] = lambda s: _scores(s, as_of)
        return snapshots.commit(spark, warehouse, {name: table for name, table in made.items() if table is not None}, base=old.number)
    finally:
        files.delete(spark, work)
