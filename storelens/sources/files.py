"""Files of the cluster's file system: listing, moving, existence."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    files, target = _at(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, path: str, folder: str) -> None:
    """Moves a file into a folder, in place of an older file of its name."""
    files, target = _at(spark, path)
    into = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.mkdirs(into)
    goal = spark._jvm.org.apache.hadoop.fs.Path(into, target.getName())
    if files.exists(goal):
        files.delete(goal, True)
    if not files.rename(target, goal):
        raise OSError(f"{path} could not be moved to {folder}")


#: Files that a task of such a write keeps open at once; with more of them it sorts after all.
OPEN_FILES = 16


@contextmanager
def few_folders(spark: SparkSession) -> Iterator[None]:
    """Writes into a few folders keep a file open in each, so that no task sorts its rows by folder first."""
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(option)
    spark.conf.set(option, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(option, before)


@contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Within it a write's shuffle files are deleted when the write is done, and not when the driver next collects garbage."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, "false")
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def inbox(spark: SparkSession, folder: str) -> list[str]:
    """Names of the delivered CSV files that wait in a folder; hidden ones are still being written."""
    return [name for name in names(spark, folder) if name.endswith(".csv") and not name.startswith(".")]


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file if there is none; says whether it did."""
    files, target = _at(spark, path)
    files.mkdirs(target.getParent())
    try:
        out = files.create(target, False)
    except Py4JJavaError as refused:
        if "FileAlreadyExists" in str(refused.java_exception.getClass().getName()) or files.exists(target):
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    files, target = _at(spark, path)
    source = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
