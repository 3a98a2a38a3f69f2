"""Distributed statistics shared by cleaning, drift and metrics.

Quantiles are exact at every size: distinct values are counted (map-side combined, so a hot value is one row), the counts
are range-partitioned by (column, value), the partitions' totals give every value its global rank, and only the
two neighbours of each wanted rank reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, tuple[list[float] | None, str]]:
    """Linear-interpolated quantiles of several columns, with the method's name."""
    if not columns:
        return {}
    spark = df.sparkSession
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # Range bounds are sampled anew whenever the plan runs, so the placed counts are written once.
    placed = cut_lineage(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("c", "part").agg(F.sum("n").alias("t"))
    w = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("c", "part", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))
    sizes = {r["c"]: r["n"] for r in totals.groupBy("c").agg(F.sum("t").alias("n")).collect()}
    wanted = sorted({(i, rank) for i, n in sizes.items() for p in probs for rank in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
    if not wanted:
        return {c: (None, "exact") for c in columns}
    ranks = spark.createDataFrame(wanted, "c int, rank long")  # two per column and quantile
    run = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("upto", F.sum("n").over(run)).join(base, ["c", "part"]).select(
        "c", "v", (F.col("before") + F.col("upto") - F.col("n")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))
    found = {(r["c"], r["rank"]): r["v"] for r in ends.join(F.broadcast(ranks), "c").where("lo <= rank and rank < hi").select("c", "rank", "v").collect()}
    out = {}
    for i, c in enumerate(columns):
        if i not in sizes:
            out[c] = None, "exact"
            continue
        values = []
        for p in probs:
            at = (sizes[i] - 1) * p
            lo, hi = math.floor(at), math.ceil(at)
            a, b = found[i, lo], found[i, hi]
            values.append(float(a) if a == b else (hi - at) * a + (at - lo) * b)
        out[c] = values, "exact"
    return out


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, smallest value on ties.

    One unpivot + ``groupBy(column, value)`` (map-side combined, so a hot value is
    cheap) + ``max_by`` over (count, -value order) per column.
    """
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns
    ])).alias("kv")).select("kv.*").where(F.col("val").isNotNull())
    counts = long.groupBy("col", "val").agg(F.count(F.lit(1)).alias("n"))
    # Highest count, then smallest value: order by (n, reversed value rank) via min_by on -n.
    best = counts.groupBy("col").agg(F.min_by("val", F.struct((-F.col("n")).alias("nn"), F.col("val"))).alias("mode"))
    return {r["col"]: r["mode"] for r in best.collect()}
