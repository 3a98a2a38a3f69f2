"""H-group queries: drift reference and PSI reports on an orders time split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..sources import fixtures
from .catalog import register

COLUMNS = ["o_totalprice", "o_orderpriority", "o_orderstatus"]
CUTOFF = "TIMESTAMP '1999-01-01'"
_PROBS = ", ".join(f"{i / 10}" for i in range(11))


def _shifted(new):
    """New data with a scaled price and one status value never seen before."""
    return new.withColumns({
        "o_totalprice": F.col("o_totalprice") * 1.3,
        "o_orderstatus": F.when(F.col("o_orderstatus") == "P", F.lit("Z")).otherwise(F.col("o_orderstatus"))})


def _sql_common(new_select: str) -> str:
    return f"""
WITH ref AS (SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate < {CUTOFF}),
new AS ({new_select}),
e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(o_totalprice, [{_PROBS}]),
                                                   lambda x: round_even(x * 1e10, 0) / 1e10))) AS edges FROM ref),
ie AS (SELECT edges[2:len(edges) - 1] AS inner_edges, len(edges) - 1 AS n_bins FROM e),
bins AS (SELECT CAST(i AS VARCHAR) AS bin FROM ie, range(n_bins) t(i)),
ref_long AS (
  SELECT 'o_totalprice' AS "column", CAST(len(list_filter(inner_edges, lambda x: x < o_totalprice)) AS VARCHAR) AS bin
  FROM ref, ie WHERE o_totalprice IS NOT NULL
  UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM ref WHERE o_orderpriority IS NOT NULL
  UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR) FROM ref WHERE o_orderstatus IS NOT NULL),
ref_sh AS (SELECT "column", bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY "column") AS p
           FROM ref_long GROUP BY 1, 2),
ref_full AS (SELECT 'o_totalprice' AS "column", b.bin, coalesce(s.p, 0.0) AS p
             FROM bins b LEFT JOIN ref_sh s ON s."column" = 'o_totalprice' AND s.bin = b.bin
             UNION ALL SELECT "column", bin, p FROM ref_sh WHERE "column" <> 'o_totalprice'),
new_long AS (
  SELECT 'o_totalprice' AS "column", CAST(len(list_filter(inner_edges, lambda x: x < o_totalprice)) AS VARCHAR) AS bin
  FROM new, ie WHERE o_totalprice IS NOT NULL
  UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM new WHERE o_orderpriority IS NOT NULL
  UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR) FROM new WHERE o_orderstatus IS NOT NULL),
new_sh AS (SELECT "column", bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY "column") AS p
           FROM new_long GROUP BY 1, 2),
j AS (SELECT coalesce(r."column", n."column") AS "column", greatest(coalesce(r.p, 0), 1e-4) AS pr,
             greatest(coalesce(n.p, 0), 1e-4) AS pn
      FROM ref_full r FULL OUTER JOIN new_sh n ON r."column" = n."column" AND r.bin = n.bin),
per_col AS (SELECT "column", sum((pn - pr) * ln(pn / pr)) AS raw FROM j GROUP BY "column"),
report AS (SELECT "column", round_even(raw * 10000, 0) / 10000 AS psi,
                  CASE WHEN raw >= 0.25 THEN 'fort' WHEN raw >= 0.10 THEN 'modere' ELSE 'stable' END AS level
           FROM per_col)
"""


_NEW = f"SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate >= {CUTOFF}"
_NEW_SHIFTED = (f"SELECT o_totalprice * 1.3 AS o_totalprice, o_orderpriority, "
                f"CASE WHEN o_orderstatus = 'P' THEN 'Z' ELSE o_orderstatus END AS o_orderstatus "
                f"FROM orders WHERE o_orderdate >= {CUTOFF}")


@register("psi_reference", _sql_common(_NEW) + """
, lohi AS (SELECT CAST(i AS VARCHAR) AS bin,
                  CASE WHEN i = 0 THEN CAST('-inf' AS DOUBLE) ELSE edges[i + 1] END AS lo,
                  CASE WHEN i = len(edges) - 2 THEN CAST('inf' AS DOUBLE) ELSE edges[i + 2] END AS hi
           FROM e, range(len(edges) - 1) t(i))
SELECT r."column", CASE WHEN r."column" = 'o_totalprice' THEN 'numerique' ELSE 'categoriel' END AS kind, r.bin,
       l.lo, l.hi, round_even(r.p * 1000000000, 0) / 1000000000 AS proportion
FROM ref_full r LEFT JOIN lohi l ON r."column" = 'o_totalprice' AND l.bin = r.bin""")
def psi_reference(spark, sf):
    ref, _ = fixtures.order_drift_split(spark, sf)
    out = D.build_reference(ref, COLUMNS)
    return out.withColumn("proportion", F.rint(F.col("proportion") * 1000000000) / 1000000000)


@register("psi_report", _sql_common(_NEW) + "SELECT * FROM report")
def psi_report(spark, sf):
    ref, new = fixtures.order_drift_split(spark, sf)
    return D.psi_by_column(new, D.build_reference(ref, COLUMNS))


@register("psi_shifted", _sql_common(_NEW_SHIFTED) + "SELECT * FROM report")
def psi_shifted(spark, sf):
    ref, new = fixtures.order_drift_split(spark, sf)
    return D.psi_by_column(_shifted(new), D.build_reference(ref, COLUMNS))


@register("drift_summary", _sql_common(_NEW_SHIFTED) + """
SELECT CASE WHEN count(*) FILTER (WHERE level = 'fort') > 0 THEN 'fort'
            WHEN count(*) FILTER (WHERE level = 'modere') > 0 THEN 'modere' ELSE 'stable' END AS global_level,
       coalesce(round_even(avg(psi) * 10000, 0) / 10000, 0.0) AS psi_mean, count(*) AS n_columns
FROM report""")
def drift_summary(spark, sf):
    ref, new = fixtures.order_drift_split(spark, sf)
    return D.drift_summary(D.psi_by_column(_shifted(new), D.build_reference(ref, COLUMNS)))


@register("drift_retrain", _sql_common(_NEW_SHIFTED) + """
SELECT *, true AS retrain FROM report WHERE level <> 'stable' ORDER BY psi DESC, "column" LIMIT 5""")
def drift_retrain(spark, sf):
    """H9: the five most drifted non-stable columns of the shifted orders, with the retrain flag."""
    ref, new = fixtures.order_drift_split(spark, sf)
    return D.retrain_hint(D.psi_by_column(_shifted(new), D.build_reference(ref, COLUMNS)))
