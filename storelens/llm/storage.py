"""Where operators keep the tables that cut their lineage.

Tables go to the folder that ``spark.checkpoint.dir`` names, which every executor
shares.  A table lives until it is dropped, at the latest until the application
ends.  The shuffle files of a write go when the table is written, as nothing
reads them any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from storelens.session import shared_folder

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Within it, a write's shuffle files are deleted when the write is done."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with shuffles_end_with_writes(spark):
        df.write.parquet(path)
    drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Has a table deleted when the application ends."""
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)


class Scratch:
    """Tables of one computation below one folder, deleted together when its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.tables = spark, new_path(spark, name), 0, {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables[name] = written(df, name, self.path(name))
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        """The table written last under a name."""
        return self.tables[name]

    def drop(self) -> None:
        drop(self.spark, self.root)
