"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creditloom.session import cut_lineage

MAX_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours, and itself, on the smallest of them. Edges point down (a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("a") > F.col("b")).cast("long"))
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    ``edges`` has two long columns ``a`` and ``b``; loops and repeats are allowed, nulls are dropped. Each
    round is a few equi joins and map-side-combined minima over the edges that are left; a hub is only ever
    joined, so AQE can split it. Rounds are written to the shared folder, never collected. An empty edge table
    gives an empty result.
    """
    start = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    current = cut_lineage(start.distinct())
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        step = _small_star(_large_star(current)).filter("a <> b").distinct()
        current, before = cut_lineage(step), mark
        mark = _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
