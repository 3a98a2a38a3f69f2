"""C-group queries: imputation, IQR clipping, derived features, imbalance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources import fixtures
from .catalog import register
from .oracle_views import CHURN, CHURN_DIRTY, with_

TARGET = "Exited"
IDS = ["CustomerId", "Surname"]
LEAKS = ["LeakNum", "LeakCat"]


def _r6(df, cols):
    return df.withColumns({c: F.rint(F.col(c) * 1000000) / 1000000 for c in cols})


_KEPT = ("Geography, Segment, Balance, EstimatedSalary, Age, NumOfProducts, Tenure, IsActiveMember, Exited, "
         "ThirdNull, MostlyNull, ConstNum")
_IMPUTED = f"""
t AS (SELECT {_KEPT} FROM churn_dirty),
med AS (SELECT quantile_cont(EstimatedSalary, 0.5) AS m_sal, quantile_cont(ThirdNull, 0.5) AS m_third FROM t),
md AS (SELECT MostlyNull AS v FROM t WHERE MostlyNull IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
imp AS (SELECT Geography, Segment, Balance, coalesce(EstimatedSalary, m_sal) AS EstimatedSalary, Age, NumOfProducts,
               Tenure, IsActiveMember, Exited, coalesce(ThirdNull, m_third) AS ThirdNull,
               coalesce(MostlyNull, (SELECT v FROM md)) AS MostlyNull, ConstNum FROM t, med)"""


@register("impute_median_mode", with_(CHURN_DIRTY, _IMPUTED) + """
SELECT * REPLACE (round_even(EstimatedSalary * 1000000, 0) / 1000000 AS EstimatedSalary,
                  round_even(ThirdNull * 1000000, 0) / 1000000 AS ThirdNull) FROM imp""")
def impute_median_mode(spark, sf):
    df = C.drop_unused(fixtures.churn_dirty(spark, sf), IDS, LEAKS, TARGET)
    out = C.apply_imputer(df, C.fit_imputer(df, TARGET))
    return _r6(out, ["EstimatedSalary", "ThirdNull"])


_CLIPPED = ("Balance", "EstimatedSalary", "Age", "NumOfProducts", "Tenure", "ThirdNull")
_BOUNDS = "bounds AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM imp"
    for c in _CLIPPED) + ")"


@register("iqr_bounds", with_(CHURN_DIRTY, _IMPUTED, _BOUNDS) + """
SELECT "column", round_even(q1 * 1000000, 0) / 1000000 AS q1, round_even(q3 * 1000000, 0) / 1000000 AS q3,
       round_even((q1 - 1.5 * (q3 - q1)) * 1000000, 0) / 1000000 AS lo,
       round_even((q3 + 1.5 * (q3 - q1)) * 1000000, 0) / 1000000 AS hi
FROM bounds WHERE q3 - q1 > 0""")
def iqr_bounds(spark, sf):
    df = C.drop_unused(fixtures.churn_dirty(spark, sf), IDS, LEAKS, TARGET)
    imp = C.apply_imputer(df, C.fit_imputer(df, TARGET))
    cb = C.fit_clipper(imp, TARGET)
    rows = [(c, *v) for c, v in cb.bounds.items()]
    out = spark.createDataFrame(rows, "column string, q1 double, q3 double, lo double, hi double")
    return _r6(out, ["q1", "q3", "lo", "hi"])


def _clip_sql(c):
    return (f"round_even(CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least(CAST({c} AS DOUBLE), "
            f"(SELECT q3 + 1.5 * (q3 - q1) FROM bounds WHERE \"column\" = '{c}')), "
            f"(SELECT q1 - 1.5 * (q3 - q1) FROM bounds WHERE \"column\" = '{c}')) END * 1000000, 0) / 1000000 AS {c}")


@register("clean_table", with_(CHURN_DIRTY, _IMPUTED, _BOUNDS) + f"""
SELECT Geography, Segment, {_clip_sql('Balance')}, {_clip_sql('EstimatedSalary')}, {_clip_sql('Age')},
       {_clip_sql('NumOfProducts')}, {_clip_sql('Tenure')}, IsActiveMember, Exited, {_clip_sql('ThirdNull')},
       MostlyNull, ConstNum
FROM imp""")
def clean_table(spark, sf):
    out = C.clean(fixtures.churn_dirty(spark, sf), IDS, LEAKS, TARGET)
    return _r6(out, list(_CLIPPED))


@register("derived_features", with_(CHURN) + """
SELECT CustomerId, CAST(coalesce(Balance = 0, false) AS INTEGER) AS SoldeNul,
       Balance / (abs(EstimatedSalary) + 1.0) AS RatioSoldeSalaire,
       Tenure / (Age + 1.0) AS AncienneteRatioAge,
       NumOfProducts / (Tenure + 1.0) AS ProduitsParAnciennete
FROM churn""")
def derived_features(spark, sf):
    df = C.add_features(fixtures.churn(spark, sf))
    return df.select("CustomerId", "SoldeNul", "RatioSoldeSalaire", "AncienneteRatioAge", "ProduitsParAnciennete")


@register("imbalance_ratio", with_(CHURN) + """
, c AS (SELECT Exited, count(*) AS n FROM churn WHERE Exited IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_classes,
       round_even(CASE WHEN count(*) < 2 THEN 1.0 ELSE max(n) / min(n) END * 1000000, 0) / 1000000 AS ratio,
       CASE WHEN count(*) < 2 THEN 1.0 ELSE max(n) / min(n) END >= 1.5 AS imbalanced
FROM c""")
def imbalance_ratio(spark, sf):
    return C.imbalance(fixtures.churn(spark, sf), TARGET)
