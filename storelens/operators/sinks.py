"""Write protocols: keyed merges, partition overwrites, published versions, file ledgers and quarantine.

A keyed table is partitioned by a hash of its key, so that a merge reads and
writes only the partitions that the new rows touch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.operators import quality
from storelens.sources import files
from storelens.sources.tables import csv_strings

BUCKETS = 64


def first_of_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: keys that are not there yet; a null in a key equals a null."""
    there = existing.select(*(F.col(c).alias(f"_there_{c}") for c in key))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_there_{c}")) for c in key))
    return first_of_key(new, key, order).join(there, same, "left_anti")


def merge_update(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The whole table after the merge: new rows replace old ones of the same key."""
    return existing.join(new.select(*key).distinct(), key, "left_anti").unionByName(first_of_key(new, key, order))


def _overwrite(rows: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions that rows has, in files of the advised size; a large partition is written by several tasks."""
    rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


# Published versions


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a published table: a version counts when its success mark is there."""
    found = [n.removeprefix("v=") for n in files.names(spark, path)]
    return sorted(int(n) for n in found if n.isdigit() and files.exists(spark, f"{path}/v={n}/_SUCCESS"))


def publish(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes the table's next version and returns its number; older ones than the last ``keep`` go.

    Readers take the newest complete version, so at any moment, also after a
    crash, they see one whole table.
    """
    spark = df.sparkSession
    done = _versions(spark, path)
    version = done[-1] + 1 if done else 1
    with files.shuffles_end_with_writes(spark):
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(f"{path}/v={version}")
    for old in [*done, version][:-keep]:
        files.delete(spark, f"{path}/v={old}")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a published table."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/v={done[-1]}")


# Keyed tables


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def keyed(spark: SparkSession, path: str) -> DataFrame:
    """A keyed table without its partition column."""
    return spark.read.parquet(path).drop("_bucket")


def upsert(new: DataFrame, path: str, key: list[str], order: list[str], update: bool = False, buckets: int = BUCKETS) -> int:
    """Merges rows into a keyed table; returns how many rows were new or replaced.

    Only partitions that hold a key of the new rows are read, and with
    ``update`` rewritten; otherwise rows are appended to them.
    """
    spark = new.sparkSession
    rows = new.withColumn("_bucket", _bucket(key, buckets))
    stored = lambda: spark.read.parquet(path) if files.exists(spark, path) else spark.createDataFrame([], rows.schema)
    touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # buckets at most
    if not touched:
        return 0
    existing = stored().where(F.col("_bucket").isin(touched))
    if update:
        _overwrite(merge_update(existing, rows, key, order), path, "_bucket")
        return new.select(*key).distinct().count()
    before = existing.count()  # of Parquet footers
    merge_ignore(existing, rows, key, order).hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(path)
    return stored().where(F.col("_bucket").isin(touched)).count() - before


# Days


def _listing(spark: SparkSession, path: str, column: str, first: str, last: str) -> dict[str, list[str]]:
    """Files of each partition of a range of days."""
    days = (n for n in files.names(spark, path) if n.startswith(f"{column}="))
    return {n: files.names(spark, f"{path}/{n}") for n in days if first <= n.removeprefix(f"{column}=") <= last}


def overwrite_partitions(df: DataFrame, path: str, column: str, first: str, last: str) -> None:
    """Replaces the partitions of a range of days, no others; days of it that have no rows any more are emptied.

    Rows outside the range are refused.  A crash between the two steps leaves
    emptied days to the repetition.
    """
    spark = df.sparkSession
    within = F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    refused = F.raise_error(F.concat(F.lit(f"a row outside {first} to {last}: "), F.coalesce(F.col(column).cast("string"), F.lit("no day"))))
    before = _listing(spark, path, column, first, last)
    _overwrite(df.where(F.when(F.coalesce(within, F.lit(False)), True).otherwise(refused)), path, column)
    after = _listing(spark, path, column, first, last)
    for day in before:
        if after.get(day) == before[day]:  # not rewritten
            files.delete(spark, f"{path}/{day}")


# Partner files


def pending_files(inbox: DataFrame, ledger: DataFrame) -> DataFrame:
    """Delivered CSV files that the ledger does not know; hidden files and others are not looked at."""
    return inbox.where(F.col("file_name").endswith(".csv") & ~F.col("file_name").startswith(".")).join(ledger.select("file_name"), "file_name", "left_anti")


def append_results(results: DataFrame, path: str, run_id: str, dataset: str, run_at: Column) -> None:
    """Appends rule results (rule, dimension, checked, failed) to the table of runs; a run that is repeated replaces its own."""
    named = results.select(F.col("rule").alias("rule_name"), "dimension", F.col("checked").alias("checked_rows"), F.col("failed").alias("failed_rows"), run_at.alias("run_at"))
    _overwrite(named.withColumns({"dataset": F.lit(dataset), "run_id": F.lit(run_id)}), path, "run_id")


def ingest_file(good: DataFrame, rejected: DataFrame, file_name: str, tables: str, key: list[str], order: list[str]) -> int:
    """Loads one file once: rows, then quarantine, then the ledger entry that makes it final.

    A crash before the ledger entry repeats the whole file, and the keyed merge
    makes the repetition harmless.
    """
    spark = good.sparkSession
    if file_name in loaded_files(spark, tables):
        return 0
    n = upsert(good, f"{tables}/deliveries", key, order)
    rejected.withColumn("source_file", F.lit(file_name)).write.mode("overwrite").option("header", True).csv(f"{tables}/quarantine/{file_name.removesuffix('.csv')}.rejected")
    entry = spark.range(1).select(F.lit(file_name).alias("file_name"), F.lit(n).cast("long").alias("rows_loaded"), F.lit(rejected.count()).cast("long").alias("rows_rejected"), F.current_timestamp().alias("ingested_at"))
    entry.write.mode("append").parquet(f"{tables}/ledger")
    return n


def loaded_files(spark: SparkSession, tables: str) -> set[str]:
    """Names in the ledger; as many as files were delivered."""
    return {r[0] for r in spark.read.parquet(f"{tables}/ledger").select("file_name").collect()} if files.exists(spark, f"{tables}/ledger") else set()


def unloaded(spark: SparkSession, names: list[str], tables: str) -> list[str]:
    """Those of the waiting files that the ledger does not know; only these come to the driver."""
    if not names or not files.exists(spark, f"{tables}/ledger"):
        return names
    waiting = spark.createDataFrame([(n,) for n in names], "file_name string")
    return sorted(r[0] for r in waiting.join(spark.read.parquet(f"{tables}/ledger").select("file_name"), "file_name", "left_anti").collect())


def ingest_inbox(spark: SparkSession, inbox: str, archive: str, tables: str, run_at: Column) -> dict[str, int]:
    """Loads the partner files that wait in a folder in one pass, and moves them to the archive.

    All files are parsed together, and rule results, quarantine and ledger are
    written for all of them, so the number of jobs does not depend on the number
    of files.  Of equal keys the first by file name is kept.  The ledger makes the
    pass final: a crash before it repeats the pass, whose merge adds only what is
    missing and counts what a file has in the table, and replaces its own results
    and quarantine.  A file that the ledger knows was loaded before a crash and is
    only moved.  Returns the rows loaded from each.
    """
    waiting = files.inbox(spark, inbox)
    new = unloaded(spark, waiting, tables)
    key, by = ["waybill", "status"], "source_file"
    counts: dict[str, int] = {}
    if new:
        rows = quality.standardise(csv_strings(spark, [f"{inbox}/{name}" for name in new], list(quality.DELIVERY_COLUMNS))).persist()
        rules = quality.delivery_rules()
        good, rejected = quality.split(rows, rules, key, [by, "collected_at", "delivered_at", "attempts", "order_id", "courier", "province"])
        try:
            results = quality.rule_results(rows, rules, key, [by])
            named = results.select(F.col("rule").alias("rule_name"), "dimension", F.col("checked").alias("checked_rows"), F.col("failed").alias("failed_rows"), run_at.alias("run_at"), F.lit("deliveries").alias("dataset"), F.col(by).alias("run_id"))
            _overwrite(named, f"{tables}/dq_results", "run_id")
            upsert(good.drop("delivered_raw"), f"{tables}/deliveries", key, [by])
            rejected.drop("delivered_raw").withColumn("file", F.col(by)).hint("rebalance", "file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").option("header", True).csv(f"{tables}/quarantine")
            names = spark.createDataFrame([(n,) for n in new], f"{by} string")
            loaded = keyed(spark, f"{tables}/deliveries").join(F.broadcast(names), by, "left_semi").groupBy(by).agg(F.count("*").alias("rows_loaded"))
            bad = rejected.groupBy(by).agg(F.count("*").alias("rows_rejected"))
            zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
            entries = names.join(loaded, by, "left").join(bad, by, "left").select(F.col(by).alias("file_name"), zero("rows_loaded"), zero("rows_rejected"), F.current_timestamp().alias("ingested_at")).persist()
            entries.coalesce(1).write.mode("append").parquet(f"{tables}/ledger")  # a row for each waiting file
            counts = {r["file_name"]: r["rows_loaded"] for r in entries.select("file_name", "rows_loaded").collect()}
            entries.unpersist()
        finally:
            rows.unpersist()
    for name in waiting:
        files.move(spark, f"{inbox}/{name}", archive)
    return counts
