"""Connected components of an edge table, by rounds of joins and aggregations over the edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import release, stored


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node that hangs on another one hangs on no second one and carries none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("carries")))
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("carries").alias("carries"))
    return not sums.agg(F.max(F.expr("hangs > 1 or hangs + carries > 1")).alias("x")).first()["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of (a, b) the least node that its edges reach.

    Large-star and small-star rounds: every node hangs its larger, then its smaller neighbours on the least one, until
    each edge points at the least node of its component. The number of rounds grows with the logarithm of the longest
    path. Hubs are safe: the least neighbour is an aggregate that collapses before its shuffle, and the join back to the
    edges can be split. Nulls and loops are ignored; without edges the result is empty.
    """
    edges = stored(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
                   .where("a > b").distinct(), "edges")
    # Edges point downwards, so the centre of a star is the least node of its component.
    while not _all_stars(edges):
        before = edges
        # Large star: each neighbour above a node moves to the least neighbour of that node (or the node itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        # Small star: a node and its neighbours below it move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct(), "edges")
        release(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
