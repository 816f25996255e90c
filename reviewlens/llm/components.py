"""Connected components by alternating star contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import release, stage


def _with_least(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) with the least of v over all edges of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """All edges lead straight to a root: no node has two of them, and none is both an end and a start."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out")).unionAll(edges.select(F.col("v").alias("n"), F.lit(0).alias("out")))
    mixed = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return mixed.where("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from every node of ``edges`` (a, b; undirected).

    Each round hangs the larger neighbours of every node, then its smaller ones, on the least neighbour; the number of
    rounds is logarithmic in the length of the longest chain. A node with very many neighbours is only ever aggregated
    (partial minimum) and joined (which adaptive execution splits), never gathered. Null ends and loops are ignored; an
    empty input gives an empty result.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    current = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(current):
        # Large star: among both directions, larger neighbours go to the least of all neighbours and the node itself.
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        ).distinct()
        # Small star: smaller neighbours and the node itself go to the least of the smaller neighbours.
        low = _with_least(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        before, current = current, stage(small.where(F.col("u") != F.col("v")).distinct())
        release(before)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
