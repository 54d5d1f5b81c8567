"""The engine's Spark session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """UTC, adaptive execution and RocksDB state; everything else is the cluster's.

    Options go in by keyword with dots written as double underscores.
    """
    builder = SparkSession.builder.appName("storelens")
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    if shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    options |= {k.replace("__", "."): v for k, v in more.items()}
    return builder.config(map=options).getOrCreate()


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose driver is its executor, may leave it unset and
    has a temporary folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        session = spark.sparkContext.applicationId
        if session not in _local:
            _local[session] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        named = _local[session]
    return named.rstrip("/")
