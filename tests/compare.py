"""Compares a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os
from typing import Any

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v: Any) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, str | bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).to_numpy().tolist())


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
