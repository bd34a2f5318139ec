"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node with the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, with the smallest of them (a > b in and out)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and isn't the smallest of its component.

    Each round is a table in the shared folder, so no lineage grows; the rounds end when the
    edges no longer change, after about as many as the logarithm of the longest path.
    """
    oriented = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = written(oriented.distinct(), "edges"), None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = written(small_star(large_star(now).distinct()).distinct(), "edges")
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
