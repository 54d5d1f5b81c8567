"""Batch sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, empty while nothing has landed there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def partitioned_since(spark: SparkSession, path: str, column: str, since: str) -> DataFrame:
    """A hive-partitioned folder from a date on; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col(column) >= F.lit(since).cast("date"))


def csv_strings(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV files with every column a string and blanks as empty strings, with the file's name; a quote inside quotes is doubled."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, nullValue="\u0000", escape='"')
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns), F.col("_metadata.file_name").alias("source_file"))
