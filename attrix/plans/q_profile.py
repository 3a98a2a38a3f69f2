"""B-group queries: profile, roles, leaks, missing values, class balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import fixtures
from .catalog import register
from .oracle_views import CHURN_DIRTY, with_

# Columns of ``churn_dirty`` and their storage kind; the oracle SQL below is
# generated from this list (one UNION ALL branch per column).
DIRTY_COLUMNS = (("CustomerId", "int"), ("Surname", "text"), ("Geography", "text"), ("Segment", "text"),
                 ("Balance", "float"), ("EstimatedSalary", "float"), ("Age", "int"), ("NumOfProducts", "int"),
                 ("Tenure", "int"), ("IsActiveMember", "int"), ("Exited", "int"), ("LeakNum", "float"),
                 ("LeakCat", "text"), ("ThirdNull", "float"), ("MostlyNull", "text"), ("ConstNum", "float"))
TARGET = "Exited"
# DuckDB spellings of the text date formats in attrix.functions.scalars.DATE_FORMATS.
_DUCK_DATE_FORMATS = ("'%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', "
                      "'%d-%m-%Y', '%Y/%m/%d', '%b %d, %Y', '%d %b %Y'")


def _stats_sql() -> str:
    parts = []
    for i, (c, k) in enumerate(DIRTY_COLUMNS):
        numeric = k in ("int", "float")
        lo = f"CAST(min({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        hi = f"CAST(max({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        if numeric and c != TARGET:
            x = f"CASE WHEN {TARGET} IS NOT NULL THEN CAST({c} AS DOUBLE) END"
            y = f"CASE WHEN {c} IS NOT NULL THEN CAST({TARGET} AS DOUBLE) END"
            corr = (f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 "
                    f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")
        else:
            corr = "CAST(NULL AS DOUBLE)"
        date_share = (f"count(*) FILTER (WHERE try_strptime({c}, [{_DUCK_DATE_FORMATS}]) IS NOT NULL) / count(*)"
                      if k == "text" else "CAST(NULL AS DOUBLE)")
        purity = (f"(SELECT avg(nt) FROM (SELECT count(DISTINCT {TARGET}) AS nt FROM churn_dirty "
                  f"WHERE {c} IS NOT NULL GROUP BY {c}))")
        vals = (f"(SELECT array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:50], '|') "
                f"FROM churn_dirty WHERE {c} IS NOT NULL)")
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS name, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS n_missing, "
            f"count(DISTINCT {c}) AS nd, {lo} AS lo, {hi} AS hi, {corr} AS corr, {date_share} AS date_share, "
            f"{purity} AS purity, {vals} AS vals FROM churn_dirty")
    return "stats AS (" + "\nUNION ALL ".join(parts) + ")"


_ID_REGEX = P.ID_PATTERN.pattern

_DECIDE = f"""
typed AS (
  SELECT *, CASE WHEN kind = 'bool' THEN 'booleen' WHEN kind = 'datetime' THEN 'date'
                 WHEN kind IN ('int', 'float') THEN CASE WHEN nd <= 2 THEN 'booleen' ELSE 'numerique' END
                 WHEN n > 0 AND coalesce(date_share, 0) > 0.9 THEN 'date'
                 WHEN nd <= 2 THEN 'booleen'
                 WHEN nd / n < 0.5 AND nd <= 50 THEN 'categoriel' ELSE 'texte' END AS type,
            name <> '{TARGET}' AND (regexp_matches(name, '{_ID_REGEX}', 'i')
               OR ((kind = 'int' OR kind NOT IN ('bool', 'int', 'float')) AND nd / n >= 0.9)) AS is_id
  FROM stats),
flagged AS (
  SELECT *, NOT is_id AND name <> '{TARGET}' AND (coalesce(abs(corr) >= 0.95, false)
            OR (nd > 1 AND nd <= greatest(20, n // 10) AND coalesce(purity <= 1.0, false))) AS is_leak
  FROM typed)"""


def _profile(spark, sf):
    return P.build_profile(fixtures.churn_dirty(spark, sf), target=TARGET)


@register("profile_stats", with_(CHURN_DIRTY, _stats_sql()) + """
SELECT name AS column, n AS n_rows, n_missing, round_even(n_missing * CAST(100.0 AS DOUBLE) / n * 100, 0) / 100 AS missing_pct,
       nd AS n_distinct, lo AS min_value, hi AS max_value FROM stats""")
def profile_stats(spark, sf):
    df = fixtures.churn_dirty(spark, sf)
    return P.stats_frame(spark, P.column_stats(df, TARGET))


@register("column_roles", with_(CHURN_DIRTY, _stats_sql(), _DECIDE) + f"""
SELECT ordinal, name, type,
       CASE WHEN name = '{TARGET}' THEN 'cible' WHEN is_leak THEN 'fuite' WHEN is_id THEN 'identifiant' ELSE 'feature' END AS role,
       round_even(n_missing * CAST(100.0 AS DOUBLE) / n * 100, 0) / 100 AS missing_pct, nd AS n_distinct,
       CASE WHEN type IN ('categoriel', 'booleen') THEN vals END AS "values",
       CASE WHEN type = 'numerique' THEN lo END AS min, CASE WHEN type = 'numerique' THEN hi END AS max
FROM flagged""")
def column_roles(spark, sf):
    prof = _profile(spark, sf).to_frame(spark)
    return prof.withColumn("values", F.array_join("values", "|"))


@register("leak_scores", with_(CHURN_DIRTY, _stats_sql(), _DECIDE) + f"""
SELECT name AS column, round_even(abs(corr) * 1000000, 0) / 1000000 AS abs_corr,
       CASE WHEN nd > 1 AND nd <= greatest(20, n // 10) THEN round_even(purity * 1000000, 0) / 1000000 END AS purity,
       is_leak
FROM flagged WHERE NOT is_id AND name <> '{TARGET}'""")
def leak_scores(spark, sf):
    df = fixtures.churn_dirty(spark, sf)
    stats = P.column_stats(df, TARGET)
    ids = P.detect_ids(stats, TARGET)
    return P.leak_frame(spark, stats, TARGET, ids).withColumns({
        "abs_corr": F.rint(F.col("abs_corr") * 1000000) / 1000000,
        "purity": F.rint(F.col("purity") * 1000000) / 1000000})


@register("missing_report", with_(CHURN_DIRTY, _stats_sql()) + """
SELECT name AS column, pct AS missing_pct, pct >= 30 AS critical,
       CASE WHEN pct >= 30 THEN 'high' WHEN pct >= 10 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT name, round_even(n_missing * CAST(100.0 AS DOUBLE) / n * 100, 0) / 100 AS pct FROM stats)
WHERE pct > 0""")
def missing_report(spark, sf):
    return P.missing_report(_profile(spark, sf).to_frame(spark))


@register("class_balance", with_(CHURN_DIRTY) + """
, c AS (SELECT CAST(Exited AS VARCHAR) AS class, count(*) AS n FROM churn_dirty WHERE Exited IS NOT NULL GROUP BY 1),
s AS (SELECT class, n, round_even(n * CAST(100.0 AS DOUBLE) / sum(n) OVER () * 100, 0) / 100 AS pct,
             count(*) OVER () AS k FROM c)
SELECT class, n, pct, CASE WHEN min(pct) OVER () < 15 THEN 'fort' WHEN min(pct) OVER () < 35 THEN 'modere'
                           ELSE 'equilibre' END AS level
FROM s WHERE k BETWEEN 2 AND 10""")
def class_balance(spark, sf):
    return P.class_balance(fixtures.churn_dirty(spark, sf), TARGET)


@register("schema_groups", with_(CHURN_DIRTY, _stats_sql(), _DECIDE) + f"""
SELECT name AS column,
       CASE WHEN name = '{TARGET}' THEN 'target' WHEN is_id THEN 'id'
            WHEN kind IN ('bool', 'int', 'float') AND nd / n <= 0.05 AND nd <= 10 THEN 'categorical'
            WHEN kind IN ('bool', 'int', 'float') THEN 'numeric' ELSE 'categorical' END AS "group",
       is_leak AS leak
FROM flagged""")
def schema_groups(spark, sf):
    prof = _profile(spark, sf)
    rep = P.schema_report(prof)
    rows = []
    for s in prof.stats:
        grp = ("target" if s.name == rep["target"] else "id" if s.name in rep["ids"]
               else "categorical" if s.name in rep["categorical"] else "numeric")
        rows.append((s.name, grp, s.name in rep["leaks"]))
    return spark.createDataFrame(rows, "column string, `group` string, leak boolean")
