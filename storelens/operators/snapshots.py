"""One commit over several tables.

A snapshot is a manifest that names the folder of every table.  New tables are
written to folders of their own, and the manifest with the next number is then
created only if there is none: that one file makes all of them visible at once.
Until then, and after a crash at any step, readers have the snapshot before.  Of
two writers that start from one snapshot one creates the manifest; the other
loses, and its folders go.  Tables that a commit does not write are carried over.

A table may be divided into parts, of which each is a folder that the manifest
names.  A commit then replaces only some parts, and the others are carried over.

A manifest that a crash left unfinished is no snapshot, and its number is not
used again.  Folders are deleted with the last manifest that names them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.sources import files

KEEP = 2


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot that this one started from."""


class Parts(NamedTuple):
    """New rows of some parts of a table: all parts, or those in ``replaced``, of which those without rows go.

    part names a row's part; what it gives as text must do as a folder's name.
    sort: a column by which files are sorted, so that reads of few of its values skip most of a file.
    derived: columns of rows that follow from others; they are made where they are written, and not moved.
    columns: the table's, if rows have others too, from which derived ones follow; all, if not given.
    """

    rows: DataFrame
    part: Column
    replaced: Collection[str] | None = None
    sort: str | None = None
    derived: Mapping[str, Column] = {}
    columns: Collection[str] | None = None


#: How a manifest names a table: its folder, or its schema and the folder of each part.
Entry = str | dict[str, Any]
#: The part of rows whose part is null.
NO_PART = "none"


def part_name(part: Column) -> Column:
    return F.coalesce(part.cast("string"), F.lit(NO_PART))


def _folders(tables: Mapping[str, Entry]) -> set[str]:
    return {path for entry in tables.values() for path in ([entry] if isinstance(entry, str) else entry["parts"].values())}


def _written(spark: SparkSession, warehouse: str, folder: str, table: DataFrame | Parts, before: Entry | None) -> Entry:
    """Writes a table or some parts of it, and returns how the manifest names it."""
    if isinstance(table, DataFrame):
        with files.shuffles_end_with_writes(spark):
            table.write.option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(f"{warehouse}/{folder}")
        return folder
    columns = list(table.columns or table.rows.columns)
    rows = table.rows.drop(*table.derived).withColumn("_part", part_name(table.part)).hint("rebalance", "_part").withColumns(table.derived).select(*columns, "_part")
    schema = rows.drop("_part").schema
    if table.sort is not None:
        rows = rows.sortWithinPartitions("_part", table.sort)
    # A task has few parts, as rows are dealt out by them.
    with files.shuffles_end_with_writes(spark), files.few_folders(spark):
        rows.write.option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("_part").parquet(f"{warehouse}/{folder}")
    new = {n.removeprefix("_part="): f"{folder}/{n}" for n in files.names(spark, f"{warehouse}/{folder}") if n.startswith("_part=")}
    kept = {} if table.replaced is None or not isinstance(before, dict) else {p: path for p, path in before["parts"].items() if p not in table.replaced}
    if table.replaced is not None and not set(new) <= set(table.replaced):
        raise ValueError(f"rows outside the parts that are replaced: {sorted(set(new) - set(table.replaced))[:5]}")
    return {"schema": schema.json(), "parts": kept | new}


def _numbers(spark: SparkSession, warehouse: str) -> list[int]:
    found = (n.removesuffix(".json") for n in files.names(spark, f"{warehouse}/_snapshots"))
    return sorted(int(n) for n in found if n.isdigit())


def manifest(spark: SparkSession, warehouse: str, number: int) -> dict[str, Entry] | None:
    """Table -> folder or parts, or nothing where the manifest is not whole."""
    text = files.text(spark, f"{warehouse}/_snapshots/{number}.json")
    try:
        return json.loads(text)["tables"]
    except (ValueError, KeyError):
        return None


def latest(spark: SparkSession, warehouse: str) -> tuple[int, dict[str, Entry]]:
    """The number of the newest whole snapshot and its tables; 0 and none before the first."""
    for number in reversed(_numbers(spark, warehouse)):
        tables = manifest(spark, warehouse, number)
        if tables is not None:
            return number, tables
    return 0, {}


#: A table, or what makes it (or nothing) from the tables that are written before it in the same commit.
Made = "DataFrame | Parts | Callable[[Snapshot], DataFrame | Parts | None]"


def commit(spark: SparkSession, warehouse: str, tables: Mapping[str, Made], base: int | None = None, keep: int = KEEP) -> int:
    """Writes tables in their order and makes them visible together; returns the snapshot's number.

    A table may be made from those before it: it is then given as a function of
    the snapshot as it will be, and what they hold is not computed again.
    base: the snapshot that the tables were made from, the newest if not given.
    """
    newest, there = latest(spark, warehouse)
    if base is not None and base != newest:
        raise Conflict(f"snapshot {newest} has been committed since {base}")
    number = max([newest, *_numbers(spark, warehouse)]) + 1
    runs = {name: f"{name}/run={uuid.uuid4().hex}" for name in tables}
    try:
        written: dict[str, Entry] = {}
        for name, table in tables.items():
            found = table(Snapshot(spark, warehouse, (number, there | written))) if callable(table) else table
            if found is not None:
                written[name] = _written(spark, warehouse, runs[name], found, there.get(name))
        if not files.create(spark, f"{warehouse}/_snapshots/{number}.json", json.dumps({"tables": there | written})):
            raise Conflict(f"snapshot {number} has been committed by another writer")
    except (Conflict, ValueError, Py4JJavaError, PySparkException):
        for path in runs.values():
            files.delete(spark, f"{warehouse}/{path}")
        raise
    _expire(spark, warehouse, keep)
    return number


def _expire(spark: SparkSession, warehouse: str, keep: int) -> None:
    """Deletes all but the last snapshots, and the folders that only they name."""
    found = {n: manifest(spark, warehouse, n) for n in _numbers(spark, warehouse)}
    whole = [n for n, tables in found.items() if tables is not None]
    held = set().union(*(_folders(found[n]) for n in whole[-keep:]))
    run = lambda path: "/".join(path.split("/")[:2])
    runs = {run(path) for path in held}
    for n in whole[:-keep]:
        gone = _folders(found[n]) - held
        for path in {path if run(path) in runs else run(path) for path in gone}:
            files.delete(spark, f"{warehouse}/{path}")
        files.delete(spark, f"{warehouse}/_snapshots/{n}.json")


class Snapshot:
    """All tables as of one commit, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, warehouse: str, at: tuple[int, dict[str, Entry]] | None = None):
        """at: a number and its tables, if not the newest ones."""
        self.spark, self.warehouse = spark, warehouse
        self.number, self.tables = latest(spark, warehouse) if at is None else at
        self._whole: dict[str, DataFrame] = {}  # whose folders are listed once

    def parts(self, name: str) -> list[str]:
        """Names of a divided table's parts."""
        entry = self.tables[name]
        if isinstance(entry, str):
            raise ValueError(f"{name} is not divided into parts")
        return sorted(entry["parts"])

    def read(self, name: str, parts: Collection[str] | None = None) -> DataFrame:
        """A table, or of a divided one some parts; no others are listed or opened."""
        if name not in self.tables:
            raise FileNotFoundError(f"{name} is not in snapshot {self.number} of {self.warehouse}")
        entry = self.tables[name]
        if isinstance(entry, str):
            return self.spark.read.parquet(f"{self.warehouse}/{entry}")
        if parts is None and name in self._whole:
            return self._whole[name]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.warehouse}/{path}" for part, path in sorted(entry["parts"].items()) if parts is None or part in parts]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if parts is None:
            self._whole[name] = found
        return found
