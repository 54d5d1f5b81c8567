"""Streaming twins of batch queries: the tables' events arrive in deliveries, one micro-batch and more each.

Every delivery is laid down as message files and the streaming query is started
on them again from its checkpoint, so state, watermark and sinks go on over
restarts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storelens.operators import cdc as changes
from storelens.operators import clicks
from storelens.plans import live
from storelens.session import shared_folder
from storelens.sources import adapters, files
from storelens.sources.inputs import Landed
from storelens.streaming import jobs, sources, views

DELIVERIES = 3
#: Messages repeat their field names, so they take a tenth of their size; this codec needs no native library.
TEXT_CODEC = "gzip"
#: First days of the second and third delivery of clicks.
CUTS = ("2024-01-11", "2024-01-21")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Messages carry the image before, so a key's changes have to meet; here they lie together from the start.
LOGS = {"orders": partial(adapters.order_changes, together=True), "order_items": adapters.order_item_changes, "products": partial(adapters.product_changes, together=True), "customers": adapters.customer_changes, "inventory": adapters.inventory_changes}


def log(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's change messages with their places; keys lie in one partition each, and no two messages of one share an offset."""
    key = changes.KEYS[table][0]
    finer = {"order_items": F.col("product_id"), "products": (F.col("price") * 100).cast("long")}.get(table)  # where the log's offsets repeat
    logged = LOGS[table](spark, sf_dir).withColumn("_offset", F.col("kafka_offset") if finer is None else F.col("kafka_offset") * F.lit(1 << 32) + finer)
    made = changes.to_envelopes(logged, table, key, "_offset")
    return made.select(F.lit(f"shop.{table}").alias("topic"), F.pmod(F.col(key), F.lit(4)).cast("int").alias("kafka_partition"), F.col("_offset").alias("kafka_offset"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), "value")


def _deliver(spark: SparkSession, sf_dir: str, root: str, tables: set[str], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Three deliveries of tables' changes, which come out of order and every tenth one twice."""
    for table in sorted(tables):
        first = F.pmod(F.xxhash64("kafka_offset"), F.lit(DELIVERIES - 1)).cast("int")
        again = F.when(F.pmod(F.hash("kafka_offset"), F.lit(10)) == 0, first + 1)
        # Both times from one pass: each message is built once.
        messages = log(spark, sf_dir, table).withColumn("delivery", F.explode(F.array_compact(F.array(first, again))))
        with files.few_folders(spark):
            messages.write.option("partitionOverwriteMode", "static").partitionBy("delivery").option("compression", "zstd").parquet(f"{root}/staged/{table}")
    for n in range(DELIVERIES):
        for table in sorted(tables):
            _arrive(spark, f"{root}/staged/{table}", n, f"{root}/log/{table}")
        start(sources.log_folder(spark, f"{root}/log/*/*", 10_000)).awaitTermination()


def _arrive(spark: SparkSession, staged: str, delivery: int, into: str) -> None:
    """A delivery's folder moves to where the stream looks; nothing is written again."""
    if files.exists(spark, f"{staged}/delivery={delivery}"):
        files.move(spark, f"{staged}/delivery={delivery}", into)


def landed(spark: SparkSession, sf_dir: str, *tables: str) -> Landed:
    """Inputs of which the tables' changes have come through the stream."""
    root = folder(spark, "landed")
    _deliver(spark, sf_dir, root, set(tables), lambda m: jobs.cdc_query(m, f"{root}/cdc", f"{root}/state", every=None, fold_every=2))
    return Landed(lambda s: jobs.landed_changes(s, f"{root}/cdc"), sf_dir)


def live_view(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Views kept over the deliveries of the tables that they take."""
    root = folder(spark, "live")
    tables = set(views.wanted(names))
    _deliver(spark, sf_dir, root, tables, lambda m: jobs.live_query(m, f"{root}/views", f"{root}/state", every=None, names=names))
    return [views.read(spark, f"{root}/views", n) for n in names]


def status_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    (board,) = live_view(spark, sf_dir, "status_board")
    return board.where("orders <> 0")


def day_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    (days,) = live_view(spark, sf_dir, "day_kpis")
    return days.withColumn("revenue", F.col("revenue").cast("double"))


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    (days,) = live_view(spark, sf_dir, "product_days")
    return live.ranked_products(days.withColumn("revenue", F.col("revenue").cast("double")))


def low_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    (stock,) = live_view(spark, sf_dir, "stock")
    return stock.where(F.col("stock_on_hand") <= live.LOW_STOCK).select("product_id", "stock_on_hand")


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    (recent,) = live_view(spark, sf_dir, "recent_orders")
    return recent.withColumn("order_total", F.col("order_total").cast("double")).drop("kafka_offset")


def customer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cards,) = live_view(spark, sf_dir, "customer_cards")
    return cards.drop(*views.ORDER)


def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cards,) = live_view(spark, sf_dir, "product_cards")
    return cards.drop("kafka_offset").withColumn("price", F.col("price").cast("double"))


def _replay(messages: DataFrame, root: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """messages: value, and delivery from 0 on."""
    spark = messages.sparkSession
    messages.select("delivery", "value").write.option("partitionOverwriteMode", "static").partitionBy("delivery").option("compression", TEXT_CODEC).text(f"{root}/staged")
    for n in range(DELIVERIES):
        _arrive(spark, f"{root}/staged", n, f"{root}/messages")
        start(sources.folder(spark, f"{root}/messages/*", files_per_trigger=10_000)).awaitTermination()


def _by_time(at: str) -> Column:
    return sum((F.col(at) >= F.lit(day).cast("timestamp_ntz")).cast("int") for day in CUTS)


def _clicks(spark: SparkSession, sf_dir: str, flush: bool = False, late: bool = False) -> DataFrame:
    """late: every 25th event comes one delivery after its time."""
    rows = adapters.clicks(spark, sf_dir).withColumn("delivery", _by_time("event_time"))
    if late:
        rows = rows.withColumn("delivery", F.when(F.col("event_id") % 25 == 0, F.least(F.col("delivery") + 1, F.lit(DELIVERIES - 1))).otherwise(F.col("delivery")))
    if flush:  # one event far ahead moves the watermark past all timers
        end = rows.orderBy(F.desc("event_time")).limit(1)
        rows = rows.unionByName(end.withColumns({"event_id": F.lit(-1).cast("long"), "session_id": F.lit("flush"), "event_type": F.lit("page_view"), "event_time": F.col("event_time") + F.expr("interval 1 day")}))
    return clicks.to_messages(rows, "delivery")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and distinct ids of each landed day."""
    root = folder(spark, "replay")
    _replay(_clicks(spark, sf_dir), root, lambda m: jobs.bronze_query(m, f"{root}/bronze", f"{root}/state", every=None))
    landed = spark.read.parquet(f"{root}/bronze")
    return landed.groupBy("event_date").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


def funnel(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """Events of each minute and stage, from update-mode cells; events behind the watermark count for nothing."""
    root = folder(spark, "replay")
    _replay(_clicks(spark, sf_dir, late=late), root, lambda m: jobs.funnel_query(m, f"{root}/cells", f"{root}/state", every=None, hours=None, fold_every=3))
    return jobs.funnel_cells(spark, f"{root}/cells").select("window_start", "stage", "events")


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abandoned carts from keyed state."""
    root = folder(spark, "replay")
    _replay(_clicks(spark, sf_dir, flush=True), root, lambda m: jobs.carts_query(m, f"{root}/alerts", f"{root}/state", every=None, fold_every=2))
    alerts = jobs.cart_alerts(spark, f"{root}/alerts")
    return alerts.select("session_id", "customer_id", "cart_value", "items", F.date_trunc("second", "last_activity_at").cast("timestamp_ntz").alias("last_activity_second"))


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Order changes landed from a stream in which every tenth change is delivered twice."""
    root = folder(spark, "replay")
    first = changes.to_envelopes(adapters.order_changes(spark, sf_dir), "orders").withColumn("delivery", F.pmod("kafka_offset", F.lit(DELIVERIES - 1)).cast("int"))
    again = first.where("kafka_offset % 10 = 0").withColumn("delivery", F.col("delivery") + 1)
    _replay(first.unionByName(again), root, lambda m: jobs.cdc_query(m, f"{root}/cdc", f"{root}/state", every=None, fold_every=2))
    return f"{root}/cdc"


def cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed order changes by operation, each once."""
    return jobs.new_changes(spark, _landed(spark, sf_dir)).groupBy("op").agg(F.count("*").alias("changes"))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by table and operation, as the stream counted them batch by batch."""
    return jobs.change_counts(spark, _landed(spark, sf_dir))
