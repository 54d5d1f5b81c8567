"""The four streaming queries.  Each has its own checkpoint; effects are keyed, so replays change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from storelens.operators import cdc, clicks, sinks
from storelens.session import ROCKSDB
from storelens.streaming import cart_state, views
from storelens.streaming.folders import FOLD_EVERY, BatchFolders

WATERMARK = "2 minutes"


def _start(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Runs on a trigger, or once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def bronze_query(messages: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Parsed clicks as Parquet by UTC day, exactly once by the file sink's log."""
    rows = clicks.parse_messages(messages).withColumn("ingested_at", F.current_timestamp())
    return _start(rows.writeStream.format("parquet").option("path", path).partitionBy("event_date").outputMode("append"), checkpoint, every)


#: Cells older than this, by the newest one, are dropped when batches are folded.
FUNNEL_HOURS = 6


def _last_cells(rows: DataFrame) -> DataFrame:
    rest = ["sessions", "events"]
    last = rows.groupBy("window_start", "stage").agg(F.max("batch").alias("batch"), F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select("window_start", "stage", *(F.col(f"r.{c}").alias(c) for c in rest), "batch")


def _recent_cells(hours: int | None) -> Callable[[DataFrame], DataFrame]:
    def keep(rows: DataFrame) -> DataFrame:
        cells = _last_cells(rows)
        if hours is None:
            return cells
        newest = rows.agg(F.max("window_start").alias("_newest"))
        return cells.crossJoin(F.broadcast(newest)).where(F.col("window_start") >= F.col("_newest") - F.make_dt_interval(hours=F.lit(hours))).drop("_newest")

    return keep


def funnel_folders(spark: SparkSession, path: str, hours: int | None = FUNNEL_HOURS, fold_every: int = FOLD_EVERY) -> BatchFolders:
    return BatchFolders(spark, path, fold_every, _recent_cells(hours))


def funnel_query(messages: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds", hours: int | None = FUNNEL_HOURS, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """One-minute cells in update mode; a cell that late events revise is overwritten by key.

    hours: how long a cell is kept; None keeps all.
    """
    parsed = clicks.parse_messages(messages).withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", WATERMARK)
    cells = clicks.funnel_windows(parsed, exact=False)
    folders = funnel_folders(messages.sparkSession, path, hours, fold_every)
    return _start(cells.writeStream.outputMode("update").foreachBatch(folders.write), checkpoint, every)


def funnel_cells(spark: SparkSession, path: str) -> DataFrame:
    """The last version of every cell."""
    rows = funnel_folders(spark, path).read()
    if rows is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return _last_cells(rows).drop("batch")


def carts_query(messages: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds", fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Alerts of abandoned carts; a batch that is repeated overwrites its own folders."""
    folders, carts = BatchFolders(messages.sparkSession, path, fold_every), cart_state.OpenCarts(messages.sparkSession, f"{path}/_open")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            carts.apply(batch, batch_id, lambda alerts: folders.write(alerts, batch_id))
        finally:
            batch.unpersist()

    return _start(clicks.parse_messages(messages).writeStream.foreachBatch(write), checkpoint, every)


def cart_alerts(spark: SparkSession, path: str) -> DataFrame:
    rows = BatchFolders(spark, path).read()
    return spark.createDataFrame([], cart_state.ALERT) if rows is None else rows.drop("batch")


def _change_folders(spark: SparkSession, path: str, fold_every: int = FOLD_EVERY) -> BatchFolders:
    return BatchFolders(spark, f"{path}/bronze", fold_every, partition_by=("table_name", "ingest_date"))


def cdc_query(messages: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds", fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Changes to Parquet by table and day, and counts by table and operation.

    Messages with a place are landed once each; others are told apart on reading.
    """
    spark = messages.sparkSession
    placed = set(PLACE) <= set(messages.columns)
    if placed:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    parsed = cdc.parse_envelopes(guarded(messages) if placed else messages)
    bronze, counts = _change_folders(spark, path, fold_every), BatchFolders(spark, f"{path}/counts", fold_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Counted as written, so that the messages are neither kept nor made twice.
        written = bronze.save(batch.withColumn("ingest_date", F.current_date()), batch_id)
        if written is not None:
            counts.write(written.groupBy("table_name", "op").count(), batch_id)
            bronze.fold_if_due()

    with _uncounted_state(spark):
        return _start(parsed.writeStream.foreachBatch(write), checkpoint, every)


@contextmanager
def _uncounted_state(spark: SparkSession) -> Iterator[None]:
    """A stream started within it does not look each key up once more to count the rows of its state."""
    option = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(option, "true")
    spark.conf.set(option, "false")
    try:
        yield
    finally:
        spark.conf.set(option, before)


#: How long a message's place is remembered.
GUARD = "7 days"
PLACE = ("topic", "kafka_partition", "kafka_offset")


def guarded(messages: DataFrame, keys: tuple[str, ...] = PLACE, keep: str = GUARD, at: str | None = None) -> DataFrame:
    """Messages once each: a place that was seen within ``keep`` is dropped in flight.

    The state forgets a place when the latest arrival is twice ``keep`` after it,
    so it is bounded by what arrives in that time.  at: a column of arrival times; the clock's, if not
    given, by which no message is late.  A message without a place is refused, as
    nothing tells it from another.
    """
    placed = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a message without {c}"))).otherwise(F.col(c)).alias(c) if c in keys else F.col(c) for c in messages.columns]
    timed = messages.select(*placed, (F.current_timestamp() if at is None else F.col(at)).alias("_arrived"))
    return timed.withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")


def live_query(messages: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds", names: Iterable[str] = tuple(views.VIEWS), buckets: int = views.BUCKETS, keep_days: int | None = None, at: str | None = None) -> StreamingQuery:
    """Live views from the change stream; messages carry their topic, partition and offset."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = tuple(names)
    # Read before the guard, so that places and what the views take are moved, and no messages.
    read = guarded(cdc.images(messages, views.wanted(names), *(c for c in (*PLACE, at) if c not in (None, "kafka_offset"))), at=at)

    def write(batch: DataFrame, batch_id: int) -> None:
        if len(names) == 1:  # which takes it once
            views.apply_all(batch, batch_id, path, names, buckets, keep_days)
            return
        batch.persist()
        try:
            views.apply_all(batch, batch_id, path, names, buckets, keep_days)
        finally:
            batch.unpersist()

    return _start(read.writeStream.foreachBatch(write), checkpoint, every)


def landed_changes(spark: SparkSession, path: str) -> DataFrame:
    """Parsed changes as the stream landed them; of messages with places each is there once."""
    landed = _change_folders(spark, path).read()
    if landed is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return landed.drop("batch", "ingest_date")


def new_changes(spark: SparkSession, path: str, seen: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """Landed changes once each, without those seen before.

    since: guards seen earlier (their column ``seen_at``) have expired and guard no more.
    """
    landed = _change_folders(spark, path).read()
    if landed is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    once = landed.drop("batch").dropDuplicates(["table_name", "ts_ms", "kafka_offset", "op", "after_json", "before_json"])
    if seen is None:
        return once
    guards = seen if since is None else seen.where(F.col("seen_at") >= since)
    return sinks.merge_ignore(guards, once, ["table_name", "ts_ms", "kafka_offset"], ["op"])


def change_counts(spark: SparkSession, path: str) -> DataFrame:
    """Changes by table and operation over all batches."""
    rows = BatchFolders(spark, f"{path}/counts").read()
    if rows is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    return rows.groupBy("table_name", "op").agg(F.sum("count").alias("changes"))


def run_until_any_fails(spark: SparkSession) -> None:
    spark.streams.awaitAnyTermination()
