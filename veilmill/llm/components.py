"""Connected components by alternating large and small stars, as joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, after each node's larger neighbours, or else its smaller ones and itself, are tied to the smallest of all these."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = (edges.union(turned) if large else edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = (turned if large else edges).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where("a != b").distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has several smaller neighbours, or one that has a smaller one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("less"), F.lit(0).alias("more")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("less").alias("less"), F.max("more").alias("more")).where("less > 1 or less = 1 and more = 1")
    return odd.count() > 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for the nodes of edges (a, b); null ends and loops don't count.

    A node with many links is spread over tasks: its minimum is taken from partial minima, and its edges may be
    split where they meet it. The number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = written(edges, "edges")
    while _unsettled(edges):
        # Each half is written: the second refers to the first several times, and plans of both at once are large.
        edges = written(_star(written(_star(edges, True), "edges"), False), "edges")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti"))
