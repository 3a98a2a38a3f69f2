"""Distribution drift by Population Stability Index (H1-H9).

Reference = long table ``(column, kind, bin, lo, hi, proportion)``:
* continuous numeric columns (numeric, > 2 distinct): decile edges rounded to 10
  digits, de-duplicated, ends widened to +-inf; bins are right-closed ``(lo, hi]``
  and empty bins are kept with proportion 0;
* other columns: shares of their string values (NULLs dropped).

Binning is a per-row expression against the (at most 11) inner edges of each
column - ``size(filter(edges, e -> e < v))`` - so no range join and no broadcast
of anything that grows with the data. All columns are unpivoted once and counted
by one ``groupBy(column, bin)`` with map-side combine; the PSI is a full outer
join of two tiny ``(column, bin)`` tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import is_numeric_kind, kind
from .stats import quantiles

# Number of bins, PSI floor, level cut-offs, listed columns.
N_BINS = 10
EPSILON = 1e-4
LEVEL_STRONG = 0.25
LEVEL_MODERATE = 0.10
MAX_LISTED = 15

REFERENCE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("bin", T.StringType()), T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()), T.StructField("proportion", T.DoubleType())])


def edge_column(q: Column) -> Column:
    """H2: bin edges of a column's deciles: inner ones at ten decimals without repeats, open ends (Q16: maybe one bin)."""
    cuts = F.array_distinct(F.transform(q, lambda x: F.rint(x * 1e10) / 1e10))
    inner = F.when(F.size(cuts) > 2, F.slice(cuts, 2, F.size(cuts) - 2)).otherwise(F.array().cast("array<double>"))
    return F.concat(F.array(F.lit(-math.inf)), inner, F.array(F.lit(math.inf)))


def decile_edges(spark: SparkSession, deciles: dict[str, list[float] | None]) -> dict[str, list[float]]:
    """H2: edges per column (one row per column)."""
    rows = spark.createDataFrame([(c, q or []) for c, q in deciles.items()], "name string, q array<double>")
    return {r["name"]: r["edges"] for r in rows.select("name", edge_column(F.col("q")).alias("edges")).collect()}


def _bin_expr(c: str, edges: list[float]) -> Column:
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    v = F.col(c).cast("double")
    return F.when(v.isNotNull(), F.size(F.filter(inner, lambda e: e < v)).cast("string"))


def continuous_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """H1: numeric with more than 2 distinct values."""
    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    num = [c for c in columns if is_numeric_kind(kinds[c])]
    if not num:
        return []
    nd = df.agg(*[F.count_distinct(c).alias(c) for c in num]).first().asDict()
    return [c for c in num if nd[c] > 2]


def _shares(df: DataFrame, cols: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """H3-H4: (column, bin, proportion) for every column in one unpivot + one groupBy."""
    items = []
    for c in cols:
        key = _bin_expr(c, edges[c]) if c in edges else F.col(c).cast("string")
        items.append(F.struct(F.lit(c).alias("column"), key.alias("bin")))
    long = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*").where(F.col("bin").isNotNull())
    counts = long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    # Per-column totals: one row per column, so broadcasting them is size-bounded.
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "bin", (F.col("n") / F.col("total")).alias("proportion"))


def build_reference(df: DataFrame, columns: list[str]) -> DataFrame:
    """H5: reference distributions of ``columns`` (exact quantiles, then one pass for the shares)."""
    spark = df.sparkSession
    columns = [c for c in columns if c in df.columns]
    cont = continuous_columns(df, columns)
    q = quantiles(df, cont, [i / N_BINS for i in range(N_BINS + 1)])
    edges = decile_edges(spark, {c: q[c][0] for c in cont}) if cont else {}
    shares = _shares(df, columns, edges)
    # Numeric bins: every bin present (empty ones at 0), with its edges.
    rows = [(c, str(k), e[k], e[k + 1]) for c, e in edges.items() for k in range(len(e) - 1)]
    if rows:
        bins = spark.createDataFrame(rows, "column string, bin string, lo double, hi double")
        num = (bins.join(shares, ["column", "bin"], "left")
               .select("column", F.lit("numerique").alias("kind"), "bin", "lo", "hi",
                       F.coalesce("proportion", F.lit(0.0)).alias("proportion")))
    else:
        num = spark.createDataFrame([], REFERENCE_SCHEMA)
    cat = (shares.where(~F.col("column").isin(*edges.keys()) if edges else F.lit(True))
           .select("column", F.lit("categoriel").alias("kind"), "bin",
                   F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "proportion"))
    return num.unionByName(cat)


def reference_edges(reference: DataFrame) -> dict[str, list[float]]:
    """Edges per numeric column from a stored reference (<= 11 values per column)."""
    rows = reference.where(F.col("kind") == "numerique").select("column", "lo", "hi").collect()
    out: dict[str, set] = {}
    for r in rows:
        out.setdefault(r["column"], set()).update([r["lo"], r["hi"]])
    return {c: sorted(v) for c, v in out.items()}


def psi_by_column(new: DataFrame, reference: DataFrame) -> DataFrame:
    """H6-H7: PSI per column over the union of bins (full outer join), floor 1e-4."""
    edges = reference_edges(reference)
    ref_cols = [r["column"] for r in reference.select("column").distinct().collect()]
    cols = [c for c in ref_cols if c in new.columns]
    if not cols:
        return new.sparkSession.createDataFrame([], "column string, psi double, level string")
    new_shares = _shares(new, cols, edges)
    # Columns with no non-null value in the new data are skipped (no shares at all).
    present = new_shares.select("column").distinct()
    ref = reference.where(F.col("column").isin(*cols)).select("column", "bin", F.col("proportion").alias("p_ref"))
    ref = ref.join(present, "column", "left_semi")
    j = ref.join(new_shares.withColumnRenamed("proportion", "p_new"), ["column", "bin"], "full_outer")
    pr = F.greatest(F.coalesce("p_ref", F.lit(0.0)), F.lit(EPSILON))
    pn = F.greatest(F.coalesce("p_new", F.lit(0.0)), F.lit(EPSILON))
    psi = j.groupBy("column").agg(F.sum((pn - pr) * F.ln(pn / pr)).alias("psi_raw"))
    return psi.select("column", (F.rint(F.col("psi_raw") * 10000) / 10000).alias("psi"), level(F.col("psi_raw")).alias("level"))


def level(psi: Column) -> Column:
    return F.when(psi >= LEVEL_STRONG, "fort").when(psi >= LEVEL_MODERATE, "modere").otherwise("stable")


def drift_summary(per_column: DataFrame) -> DataFrame:
    """H8: worst level wins; mean of the rounded PSI over all analysed columns (Q15)."""
    return per_column.agg(
        F.when(F.count_if(F.col("level") == "fort") > 0, "fort")
         .when(F.count_if(F.col("level") == "modere") > 0, "modere").otherwise("stable").alias("global_level"),
        F.coalesce(F.rint(F.avg("psi") * 10000) / 10000, F.lit(0.0)).alias("psi_mean"),
        F.count(F.lit(1)).alias("n_columns"))


def drift_report(per_column: DataFrame, top: int = MAX_LISTED) -> DataFrame:
    """H8: listed columns, highest PSI first (first 15)."""
    return per_column.orderBy(F.col("psi").desc(), F.col("column")).limit(top)


def retrain_hint(per_column: DataFrame, top: int = 5) -> DataFrame:
    """H9: top non-stable columns and the retrain flag."""
    return (per_column.where(F.col("level") != "stable").orderBy(F.col("psi").desc(), F.col("column")).limit(top)
            .withColumn("retrain", F.lit(True)))


def reference_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REFERENCE_SCHEMA)
