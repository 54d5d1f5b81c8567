"""Live views that the change stream keeps: each micro-batch adds its steps to keyed tables.

A view is a rule that turns changes into rows by key, and an associative rule
that combines rows of one key: sums of signed steps from the images before and
after, the last row by time and offset, or the few newest rows.  So the order in
which changes arrive does not matter, and a batch costs what it touches.

A view's table lies in buckets by key.  A batch reads the last version of the
buckets that its rows fall into, combines them and writes them as one folder,
whose success mark makes the whole batch final.  The table remembers its last
batch, so one that is repeated after a crash adds nothing, and a half-written
folder is written anew.  Versions before the last two are deleted.  Batch numbers
are those of one checkpoint: a stream that starts over takes a new folder.

Messages that are delivered again in a later batch are dropped in flight, see
``jobs.guarded``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.scalars import business_date
from storelens.operators import cdc
from storelens.sources import files

BUCKETS = 16
RECENT = 20
MONEY = "decimal(38,2)"
ORDER = ("ts_ms", "kafka_offset")


class View(NamedTuple):
    table: str
    columns: tuple[str, ...]  # of the table's images, those that its steps read
    keys: tuple[str, ...]
    steps: Callable[[DataFrame], DataFrame]  # changes of one table -> rows
    combine: Callable[[DataFrame], DataFrame]  # rows -> one row a key, of the same columns
    day: str | None = None  # a column of days by which rows expire
    when: Callable[[Column], Column] = Column.isNotNull  # of an op: whether its changes give any row


def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    def combine(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values))

    return combine


def _last(*keys: str) -> Callable[[DataFrame], DataFrame]:
    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_row"))
        return last.select(*keys, *(F.col(f"_row.{c}") for c in rest))

    return combine


def _newest(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*(F.desc(c) for c in ORDER)).limit(RECENT)


def _day_steps(orders: DataFrame) -> DataFrame:
    """A new order, its revenue, and a change to cancelled, by the day of the change."""
    new, cancelled = F.col("op") == "c", (F.col("op") == "u") & (F.col("status") == "CANCELLED") & ~F.col("previous_status").eqNullSafe(F.col("status"))
    return orders.where(new | cancelled).select(business_date(F.col("changed_at")).alias("day"), new.cast("long").alias("orders"), F.when(new, F.col("order_total")).otherwise(0).cast(MONEY).alias("revenue"), cancelled.cast("long").alias("cancelled"))


def _sold(items: DataFrame) -> DataFrame:
    return items.where("op = 'c'").select(business_date(F.col("changed_at")).alias("day"), "product_id", F.col("quantity").cast("long").alias("units"), (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("revenue"))


def _recent(orders: DataFrame) -> DataFrame:
    return orders.where("op = 'c'").select("order_id", "customer_id", "order_total", "ship_province", "payment_method", "placed_at", *ORDER)


def _kept(kind: str, *columns: str) -> Callable[[DataFrame], DataFrame]:
    """The columns of every image that is no deletion."""
    return lambda changes: changes.where("op <> 'd'").select(f"{kind}_id", *columns, *ORDER)


def _created(op: Column) -> Column:
    return op == "c"


def _there(op: Column) -> Column:
    return op != "d"


#: The views by name.
VIEWS = {
    "status_board": View("orders", ("status",), ("status",), cdc.signed_board, _summed("status")),
    "day_kpis": View("orders", ("status", "order_total"), ("day",), _day_steps, _summed("day"), "day", lambda op: op.isin("c", "u")),
    "recent_orders": View("orders", ("order_id", "customer_id", "order_total", "ship_province", "payment_method", "placed_at"), (), _recent, _newest, when=_created),
    "product_days": View("order_items", ("product_id", "quantity", "unit_price"), ("day", "product_id"), _sold, _summed("day", "product_id"), "day", _created),
    "stock": View("inventory", ("product_id", "stock_on_hand"), ("product_id",), _kept("product", "stock_on_hand"), _last("product_id"), when=_there),
    "product_cards": View("products", ("product_id", "product_name", "category", "price"), ("product_id",), _kept("product", "product_name", "category", "price"), _last("product_id"), when=_there),
    "customer_cards": View("customers", ("customer_id", "first_name", "province", "city"), ("customer_id",), _kept("customer", "first_name", "province", "city"), _last("customer_id"), when=_there),
}


def wanted(names: Iterable[str]) -> dict[str, cdc.Wanted]:
    """What views take of each table's changes."""
    out: dict[str, cdc.Wanted] = {}
    for view in (VIEWS[n] for n in names):
        there = out.get(view.table)
        out[view.table] = cdc.Wanted(view.columns, view.when) if there is None else cdc.Wanted(tuple(dict.fromkeys((*there.columns, *view.columns))), _either(there.when, view.when))
    return out


def _either(one: Callable[[Column], Column], other: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda op: one(op) | other(op)


class KeyedView:
    def __init__(self, spark: SparkSession, path: str, view: View, buckets: int = BUCKETS, keep_days: int | None = None):
        """keep_days: rows of days so long before a batch's newest day go when their bucket is written."""
        self.spark, self.path, self.view, self.buckets, self.keep_days = spark, path, view, buckets, keep_days

    def _batches(self) -> list[int]:
        """Batches that are complete."""
        found = (n.removeprefix("batch=") for n in files.names(self.spark, self.path) if n.startswith("batch="))
        return sorted(int(n) for n in found if files.exists(self.spark, f"{self.path}/batch={n}/_SUCCESS"))

    def _versions(self) -> dict[int, list[int]]:
        """The batches that wrote each bucket; buckets times two, and folders not yet deleted."""
        out: dict[int, list[int]] = {}
        for batch in self._batches():
            for name in files.names(self.spark, f"{self.path}/batch={batch}"):
                if name.startswith("bucket="):
                    out.setdefault(int(name.removeprefix("bucket=")), []).append(batch)
        return out

    def _stored(self, versions: dict[int, list[int]]) -> DataFrame | None:
        paths = [f"{self.path}/batch={batches[-1]}/bucket={b}" for b, batches in versions.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Adds a batch of typed changes; a batch that is not after the last one has been added before."""
        done = self._batches()
        if done and batch_id <= done[-1]:
            return
        new = self.view.combine(self.view.steps(changes))
        bucket = F.pmod(F.xxhash64(*self.view.keys), F.lit(self.buckets)).cast("int") if self.view.keys else F.lit(0)
        rows = new.withColumn("bucket", bucket).persist()
        try:
            newest = F.max(self.view.day) if self.view.day else F.lit(None)
            touched = {r["bucket"]: r["newest"] for r in rows.groupBy("bucket").agg(newest.alias("newest")).collect()}  # buckets at most
            versions = self._versions()
            stored = self._stored({b: versions[b] for b in touched if b in versions})
            merged = rows.drop("bucket") if stored is None else self.view.combine(stored.unionByName(rows.drop("bucket")))
            if self.keep_days is not None and any(touched.values()):
                merged = merged.where(F.col(self.view.day) > F.lit(max(d for d in touched.values() if d)) - F.make_dt_interval(days=F.lit(self.keep_days)))
            with files.few_folders(merged.sparkSession):
                merged.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/batch={batch_id}")
        finally:
            rows.unpersist()
        for b in touched:
            for old in versions.get(b, [])[:-1]:
                files.delete(self.spark, f"{self.path}/batch={old}/bucket={b}")
        self._drop_empty()

    def _drop_empty(self) -> None:
        """Folders of earlier batches that hold no bucket any more."""
        for batch in self._batches()[:-1]:
            if not any(n.startswith("bucket=") for n in files.names(self.spark, f"{self.path}/batch={batch}")):
                files.delete(self.spark, f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """The view as of the last complete batch; an error if no row has come yet."""
        found = self._stored(self._versions())
        if found is None:
            raise FileNotFoundError(f"no change has come to {self.path}")
        return found


def apply_all(batch: DataFrame, batch_id: int, path: str, names: Iterable[str], buckets: int = BUCKETS, keep_days: int | None = None) -> None:
    """One micro-batch of changes, as ``cdc.images`` reads them, to every view; each view is final by itself."""
    for name in names:
        view = VIEWS[name]
        KeyedView(batch.sparkSession, f"{path}/{name}", view, buckets, keep_days if view.day else None).apply(cdc.typed_images(batch, view.table, view.columns), batch_id)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return KeyedView(spark, f"{path}/{name}", VIEWS[name]).read()
