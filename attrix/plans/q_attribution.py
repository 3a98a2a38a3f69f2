"""F-group queries over fitted pipelines: exact tree attribution and linear attribution of every customer."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ..operators import train as T
from ..operators.attribution import Explainer
from ..sources import fixtures
from .catalog import register

TARGET, KEY = "Exited", "CustomerId"


def _explained(spark, sf, estimator):
    prep = T.prepare(fixtures.churn(spark, sf), TARGET, ids=[KEY, "Surname"], leaks=[], key=KEY)
    model = Pipeline(stages=[*prep.stages, estimator]).fit(prep.frame)
    out = Explainer.fit(model, prep.frame).explain(prep.frame, KEY, 5)
    return out.select(KEY, "risk_score", "risk_level", "method", "base_value", F.explode("factors").alias("f")).select(
        KEY, "risk_score", "risk_level", "method", "base_value", "f.*")


@register("tree_attribution")
def tree_attribution(spark, sf):
    """The five largest exact contributions to every customer's score under a fitted boosted ensemble."""
    return _explained(spark, sf, T.GBTClassifier(maxIter=20, stepSize=0.1, maxDepth=5, seed=T.SEED))


@register("linear_attribution")
def linear_attribution(spark, sf):
    """The same under a fitted logistic regression, against training means."""
    return _explained(spark, sf, T.LogisticRegression(maxIter=100, regParam=0.001, standardization=False))
