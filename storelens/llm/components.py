"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join of the
edges to it.  A node with very many neighbours is never gathered into one task:
the minima of such hubs are broadcast, and a node holds more than one in HUBS of
the rows only if there are fewer than HUBS such nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import storage

#: A node with more than one in HUBS of all rows is a hub; fewer than HUBS nodes can be.
HUBS = 1024


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Adds to the rows (u, v) the minimum m of their u; least has u, m and the count n, whose sum is at most total."""
    is_hub = F.col("n") * HUBS > total
    hubs = F.broadcast(least.where(is_hub).select("u", "m"))
    others = least.where(~is_hub).select("u", "m")
    of_others = rows.join(F.broadcast(least.where(is_hub).select("u")), "u", "left_anti").join(others, "u")
    return rows.join(hubs, "u").unionByName(of_others)


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects each node's larger neighbours to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects each node and its smaller neighbours to the smallest of them; every edge has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then the edges are the components."""
    ends = edges.select(F.col("v").alias("end")).distinct()
    per_node = edges.groupBy("u").agg(F.count("*").alias("n"))
    return per_node.join(ends, F.col("u") == F.col("end"), "left").where("n > 1 or end is not null").isEmpty()


def component_leaves(edges: DataFrame, scratch: storage.Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node but the smallest of each component; reads a table in scratch."""
    spark = edges.sparkSession
    path = scratch.path("edges")
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    now = storage.written(now, "edges", path)
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        for star in (_large_star, _small_star):
            new_path = scratch.path("edges")
            new = storage.written(star(now), "edges", new_path)
            storage.drop(spark, path)
            now, path = new, new_path
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    edges: columns u and v of one orderable type, in either direction; loops,
    repeated rows and rows with a null end count for nothing.  An empty edge
    list gives an empty table.
    """
    leaves = component_leaves(edges, storage.Scratch(edges.sparkSession, "components"), rounds)
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
