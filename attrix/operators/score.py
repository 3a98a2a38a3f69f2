"""Scoring (E1-E3): probabilities to rounded 0-100 risk scores, levels, predictions.

Two scorer shapes:
* an MLlib ``PipelineModel`` (``score_with_model``): ``transform`` then
  ``vector_to_array(probability)[1]``;
* a linear-logistic scorer given as coefficients (``LinearScorer``): the score is
  a plain column expression, so it stays inside whole-stage codegen with no
  vector assembly; a fitted ``LogisticRegressionModel`` on raw columns can be
  turned into one with ``LinearScorer.from_model``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col_, risk_level, round_half_even


def logistic_probability(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z).cast("double")))


def risk_score(p) -> Column:
    """round(P(class 1) * 100, 1) half-even, computed as rint(p*100*10)/10 (Q1, Q3)."""
    return F.rint(col_(p) * 100 * 10) / 10


def prediction(p) -> Column:
    """Class prediction: P >= 0.5 (distinct from the KPI cut score > 50, Q2)."""
    return (col_(p) >= 0.5).cast("int")


def add_levels(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    return df.withColumn("risk_level", risk_level(score_col))


@dataclass
class LinearScorer:
    """Logistic scorer z = intercept + sum(coef * column) (+ categorical one-hot terms)."""

    intercept: float
    coefficients: dict[str, float]
    categorical: dict[str, dict[str, float]] = field(default_factory=dict)

    def logit(self) -> Column:
        z = F.lit(float(self.intercept))
        for name, w in self.coefficients.items():
            z = z + F.lit(float(w)) * F.col(name).cast("double")
        for name, levels in self.categorical.items():
            term = F.lit(0.0)
            for value, w in levels.items():
                term = F.when(F.col(name) == value, F.lit(float(w))).otherwise(term)
            z = z + term
        return z

    def score(self, df: DataFrame) -> DataFrame:
        p = logistic_probability(self.logit())
        return df.withColumn("p", p).withColumn("risk_score", risk_score("p"))


def score_with_model(df: DataFrame, model, keep_probability: bool = False) -> DataFrame:
    """Score every row with a fitted MLlib model; one map-only stage, no shuffle."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    out = out.withColumn("p", vector_to_array("probability")[1])
    out = out.withColumn("risk_score", risk_score("p"))
    drop = [c for c in out.columns if c not in df.columns and c not in ("p", "risk_score")]
    out = out.drop(*drop)
    return out if keep_probability else out.drop("p")


def round_to(c, digits):
    return round_half_even(c, digits)


def score_by_tenant(df: DataFrame, tenant_col: str, models: DataFrame, base_logit: Column) -> DataFrame:
    """Score each row with its tenant's active model.

    ``models`` holds one row per tenant (``tenant``, ``intercept_shift``): the registry
    of per-tenant calibrations. It grows with the tenants, so AQE broadcasts it only
    when it measured small; every row is scored in the same single pass.
    """
    m = models.withColumnRenamed("tenant", tenant_col)
    x = df.join(m, tenant_col, "left")
    z = base_logit + F.coalesce(F.col("intercept_shift"), F.lit(0.0))
    return x.withColumn("p", logistic_probability(z)).withColumn("risk_score", risk_score("p")).drop("intercept_shift")


def tenant_calibration(df: DataFrame, tenant_col: str, target: str) -> DataFrame:
    """Per-tenant intercept shift = logit(tenant churn rate) - logit(overall rate)."""
    overall = df.select(F.avg(F.col(target).cast("double"))).scalar()
    rates = df.groupBy(F.col(tenant_col).alias("tenant")).agg(F.avg(F.col(target).cast("double")).alias("r"))
    logit = lambda r: F.ln(r / (F.lit(1.0) - r))
    return rates.select("tenant", (logit(F.col("r")) - logit(overall)).alias("intercept_shift"))
