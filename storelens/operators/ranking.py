"""Global tiles without gathering all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDARIES = 64


def _bucket(value: Column, key: Column, cuts: Column, key_cuts: Column) -> Column:
    """A bucket number that rises with (value, key).

    Values equal to a cut are buckets of their own, and only those are divided
    by key: a value that very many rows share is a cut, so no bucket is large.
    """
    tied = F.array_contains(cuts, value)
    part = F.when(tied, F.size(F.filter(key_cuts, lambda b: b < key))).otherwise(0)
    return (F.size(F.filter(cuts, lambda b: b < value)) * 2 + tied.cast("int")) * (BOUNDARIES + 2) + part


def with_tiles(df: DataFrame, tiles: int, key: str, **metrics: str) -> DataFrame:
    """Adds for each name=metric the tile of the rows ordered by (metric, key); key is unique, and neither may be null.

    The cuts between buckets are approximate quantiles, bounded in number, and
    the tiles are exact: rows are numbered inside buckets, and counts of the
    buckets before are added.  All metrics are numbered in one table of (name,
    value, key), and nothing runs before the result is asked for.
    """
    number = lambda c: F.col(c).cast("double")
    shares = [i / BOUNDARIES for i in range(1, BOUNDARIES)]
    cut = F.struct(*(F.array_distinct(F.percentile_approx(number(c), shares, 16 * BOUNDARIES)).alias(c) for c in dict.fromkeys([*metrics.values(), key])))
    cuts = df.agg(cut.alias("_cuts"))  # one row, whatever df holds
    ranked = [F.struct(F.lit(name).alias("name"), number(c).alias("value"), _bucket(number(c), number(key), F.col(f"_cuts.{c}"), F.col(f"_cuts.{key}")).alias("bucket")) for name, c in metrics.items()]
    rows = df.crossJoin(F.broadcast(cuts)).select(*df.columns, F.explode(F.array(*ranked)).alias("_r"))

    by_name = Window.partitionBy("name")  # some thousands of buckets at most
    counts = rows.groupBy("_r.name", "_r.bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("name", "bucket", (F.sum("_n").over(by_name.orderBy("bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_name).alias("_total"))
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_r.name", "_r.bucket").orderBy("_r.value", key)))
    rank = F.col("_before") + F.col("_row") - 1
    small, longer = F.floor(F.col("_total") / tiles), F.col("_total") % tiles  # that many tiles have one row more
    later = longer + F.floor((rank - longer * (small + 1)) / F.greatest(small, F.lit(1)))
    tile = F.when(rank < longer * (small + 1), F.floor(rank / (small + 1))).otherwise(later) + 1
    numbered = placed.join(F.broadcast(offsets), (F.col("_r.name") == F.col("name")) & (F.col("_r.bucket") == F.col("bucket"))).select(*df.columns, "name", tile.cast("int").alias("_tile"))
    return numbered.groupBy(*df.columns).agg(*(F.max(F.when(F.col("name") == name, F.col("_tile"))).alias(name) for name in metrics))
