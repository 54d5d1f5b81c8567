"""Abandoned carts from a stream of clicks, by event time.

A session's cart is folded from its events in the order of their times, also
across micro-batches: each product keeps its adds and the time of its last
removal, so a late add never brings back what was removed after it.  A purchase
marks the session as converted until it is idle, and no late add revives the
cart.  When the watermark is the timeout after a session's last activity, its
cart is reported if it is not converted and not empty, and its rows go; a
session that returns later starts a new cart.

``Cart`` says what a cart is, event by event; the stream does the same with
grouped rows, without a call of Python for each session.

Times are milliseconds and events have no ids: an add in the instant of a
removal counts as removed, and of two prices of one instant the larger is the
last, after the larger quantity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.sources import files

IDLE_MINUTES = 5
WATERMARK = "2 minutes"
ALERT = "session_id string, customer_id long, cart_value double, items long, last_activity_at timestamp, detected_at timestamp"

Add = tuple[int, int, float]


class Cart:
    """What one session's events leave behind; the order in which they arrive does not matter."""

    def __init__(self) -> None:
        self.customer_id: int | None = None
        self.last_ms = 0
        self.converted = False
        self.adds: dict[int, list[Add]] = {}
        self.removed: dict[int, int] = {}

    def apply(self, kind: str, ms: int, product: int | None = None, quantity: int | None = None, price: float | None = None, customer: int | None = None) -> None:
        self.last_ms = max(self.last_ms, ms)
        if customer is not None:
            self.customer_id = customer if self.customer_id is None else max(self.customer_id, customer)
        if kind == "purchase":
            self.converted = True
        elif kind == "add_to_cart" and product is not None:
            self.adds.setdefault(product, []).append((ms, 1 if quantity is None else quantity, price or 0.0))
        elif kind == "remove_from_cart" and product is not None:
            self.removed[product] = max(ms, self.removed.get(product, ms))

    def lines(self) -> dict[int, tuple[int, float]]:
        """Quantity and last price of each product left."""
        out = {}
        for product, adds in self.adds.items():
            left = [a for a in adds if product not in self.removed or a[0] > self.removed[product]]
            if left:
                out[product] = (sum(a[1] for a in left), max(left)[2])
        return {} if self.converted else out

    def value(self) -> tuple[float, int]:
        lines = self.lines().values()
        return round(sum(q * p for q, p in lines), 2), sum(q for q, _ in lines)


def timer_at(last_ms: int, watermark_ms: int, idle_minutes: int = IDLE_MINUTES) -> int:
    """Idle time after the last activity, but never in the watermark's past."""
    return max(last_ms + idle_minutes * 60_000, watermark_ms + 1)


#: Rows of open carts: adds and removals as they came, and for each session one row of its last activity.
OPEN = "session_id string, event_ms long, event_type string, customer_id long, product_id long, quantity long, price double"


def slim(clicks: DataFrame) -> DataFrame:
    """The columns of parsed clicks that carts need."""
    at = F.unix_millis(F.col("event_time").cast("timestamp"))
    return clicks.select("session_id", at.alias("event_ms"), "event_type", "customer_id", "product_id", F.col("quantity").cast("long").alias("quantity"), F.col("price").cast("double").alias("price"))


def _lines() -> Column:
    """Rows of which a cart's lines are made."""
    return F.col("event_type").isin("add_to_cart", "remove_from_cart") & F.col("product_id").isNotNull()


def compact(rows: DataFrame) -> DataFrame:
    """Rows of the same carts, in which one row of a session stands for all that changes no line."""
    seen = rows.groupBy("session_id").agg(F.max("event_ms").alias("event_ms"), F.max("customer_id").alias("customer_id"), F.max(F.col("event_type") == "purchase").alias("_bought"))
    marks = seen.withColumn("event_type", F.when(F.col("_bought"), "purchase").otherwise("seen")).drop("_bought")
    return rows.where(_lines()).unionByName(marks, allowMissingColumns=True)


def with_last(rows: DataFrame) -> DataFrame:
    """Adds the session's last activity."""
    return rows.withColumn("last_ms", F.max("event_ms").over(Window.partitionBy("session_id")))


def folded(rows: DataFrame) -> DataFrame:
    """(session_id, customer_id, cart_value, items, last_ms) of carts that are not converted and not empty, as ``Cart`` has them."""
    removed = F.max(F.when(F.col("event_type") == "remove_from_cart", F.col("event_ms"))).over(Window.partitionBy("session_id", "product_id"))
    held = _lines() & (F.col("event_type") == "add_to_cart") & (F.col("_removed").isNull() | (F.col("event_ms") > F.col("_removed")))
    quantity = F.coalesce("quantity", F.lit(1))
    add = F.when(held, F.struct(F.col("event_ms").alias("at"), quantity.alias("quantity"), F.coalesce("price", F.lit(0.0)).alias("price")))
    lines = rows.repartition("session_id").withColumn("_removed", removed).groupBy("session_id", "product_id").agg(
        F.max("event_ms").alias("last_ms"), F.max("customer_id").alias("customer_id"), F.max(F.col("event_type") == "purchase").alias("_bought"), F.sum(F.when(held, quantity)).alias("_n"), F.max(add).alias("_last")
    )
    value = F.sum(F.col("_n") * F.col("_last.price"))
    carts = lines.groupBy("session_id").agg(F.max("customer_id").alias("customer_id"), F.round(value, 2).alias("cart_value"), F.sum("_n").alias("items"), F.max("last_ms").alias("last_ms"), F.max("_bought").alias("_bought"))
    return carts.where("not _bought and items <> 0").drop("_bought")


class OpenCarts:
    """Carts of sessions that are not yet idle, as a table that each micro-batch writes anew.

    A batch's folder holds the open carts after it and the largest time seen, from
    which the next batch has its watermark.  It is final with its success mark; a
    batch that is repeated starts from the one before it, of which two are kept.
    """

    def __init__(self, spark: SparkSession, path: str, idle_minutes: int = IDLE_MINUTES):
        self.spark, self.path, self.idle_ms = spark, path, idle_minutes * 60_000

    def _before(self, batch_id: int) -> list[int]:
        found = (int(n.removeprefix("batch=")) for n in files.names(self.spark, self.path) if n.startswith("batch="))
        return sorted(n for n in found if n < batch_id and files.exists(self.spark, f"{self.path}/batch={n}/_SUCCESS"))

    def apply(self, clicks: DataFrame, batch_id: int, write: Callable[[DataFrame], None]) -> None:
        """Adds a batch of parsed clicks, gives write the alerts of carts that are idle after it, and keeps the others."""
        before = self._before(batch_id)
        stored = self.spark.read.schema(OPEN).parquet(f"{self.path}/batch={before[-1]}") if before else self.spark.createDataFrame([], OPEN)
        newest = lambda rows: rows.agg(F.max("event_ms")).first()[0]
        passed = newest(stored.where("session_id is null"))
        new = slim(clicks)
        now = max((x for x in (passed, newest(new)) if x is not None), default=None)
        if now is None:
            return
        behind = pd.Timedelta(WATERMARK) // pd.Timedelta(milliseconds=1)
        if passed is not None:  # what the watermark has passed comes too late
            new = new.where(F.col("event_ms") > passed - behind)
        rows = with_last(compact(stored.where("session_id is not null").unionByName(new))).persist()
        try:
            idle = F.col("last_ms") + self.idle_ms <= now - behind
            at = lambda ms: F.timestamp_millis(ms)
            write(folded(rows.where(idle).drop("last_ms")).select("session_id", "customer_id", "cart_value", "items", at(F.col("last_ms")).alias("last_activity_at"), at(F.lit(now - behind)).alias("detected_at")))
            mark = self.spark.range(1).select(F.lit(None).cast("string").alias("session_id"), F.lit(now).cast("long").alias("event_ms"))
            kept = rows.where(~idle).drop("last_ms").unionByName(mark, allowMissingColumns=True)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/batch={batch_id}")
        finally:
            rows.unpersist()
        for old in before[:-1]:
            files.delete(self.spark, f"{self.path}/batch={old}")


def fold(events: Iterable[dict[str, Any]]) -> Cart:
    """A cart from plain events, for tests and small tools."""
    cart = Cart()
    for e in events:
        cart.apply(e["event_type"], e["event_time_ms"], e.get("product_id"), e.get("quantity"), e.get("price"), e.get("customer_id"))
    return cart
