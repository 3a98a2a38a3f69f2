"""Exact attribution of fitted pipelines against Shapley values by all subsets."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.sql import functions as F

from attrix.operators import attribution as A
from attrix.operators import train as T


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b, c, g = rng.gauss(0, 1), rng.choice([None, 1.0, 2.0, 5.0]), rng.randint(0, 4), rng.choice(["x", "y", "z", None])
        y = int(a + (b or 0) * 0.3 + (g == "x") * 1.5 - c * 0.4 + rng.gauss(0, 0.5) > 0.3)
        rows.append((i, a, b, c, g, rng.choice(["p", "q"]), y))
    df = spark.createDataFrame(rows, "id long, Alpha double, Beta double, Count int, Grp string, Grp_x string, y int")
    return T.prepare(df, "y", ids=["id"], leaks=[], key="id")


def fitted(prepared, estimator):
    return Pipeline(stages=[*prepared.stages, estimator]).fit(prepared.frame)


def expected_value(table, stats_of, value_of, x, known, node=0):
    """The tree's value if only the features in ``known`` are known: by the row where known, else by the children's covers."""
    n = table[node]
    if n["leftChild"] < 0:
        return value_of(n)
    s = n["split"]
    left = x[s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] if s["numCategories"] < 0 else x[s["featureIndex"]] in s["leftCategoriesOrThreshold"]
    go = lambda child: expected_value(table, stats_of, value_of, x, known, child)
    if s["featureIndex"] in known:
        return go(n["leftChild"] if left else n["rightChild"])
    a, b = stats_of(table[n["leftChild"]]), stats_of(table[n["rightChild"]])
    return (a * go(n["leftChild"]) + b * go(n["rightChild"])) / (a + b)


def all_subsets(model, x):
    nodes, weights, boosted = A._saved_nodes(model)
    d = len(x)
    stats = lambda n: n["impurityStats"][0] if boosted else sum(n["impurityStats"])
    out, base = np.zeros(d), 0.0
    for tree, w in enumerate(weights):
        value = (lambda n, w=w: 2 * w * n["prediction"]) if boosted else (lambda n: n["impurityStats"][1] / sum(n["impurityStats"]) / len(weights))
        at = {s: expected_value(nodes[tree], stats, value, x, s) for k in range(d + 1) for s in map(frozenset, itertools.combinations(range(d), k))}
        base += at[frozenset()]
        for s, v in at.items():
            for j in set(range(d)) - s:
                out[j] += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (at[s | {j}] - v)
    return out, base


@pytest.mark.parametrize("kind, params", [(DecisionTreeClassifier, {"maxDepth": 4}), (RandomForestClassifier, {"numTrees": 4, "maxDepth": 5}),
                                          (GBTClassifier, {"maxIter": 4, "maxDepth": 3, "subsamplingRate": 0.8})])
def test_trees_equal_all_subsets(prepared, kind, params):
    estimator = kind(seed=1, **params)
    model = fitted(prepared, estimator)
    rows = model.transform(prepared.frame).select("features", "probability").limit(12).collect()
    x = np.stack([r["features"].toArray() for r in rows])
    trees = A.tree_leaves(model.stages[-1])
    got = A.tree_shapley(trees, x)
    p = np.array([r["probability"][1] for r in rows])
    value = np.log(p / (1 - p)) if isinstance(estimator, GBTClassifier) else p
    assert np.allclose(A.tree_values(trees, x), value, atol=1e-9)
    for row, phi, v in zip(x, got, value):
        want, base = all_subsets(model.stages[-1], row)
        assert np.abs(phi - want).max() < 1e-9
        assert abs(base - sum(t.expected() for t in trees)) < 1e-9 and abs(base + phi.sum() - v) < 1e-9


def test_deep_paths_and_hundreds_of_leaves(prepared):
    model = fitted(prepared, DecisionTreeClassifier(maxDepth=14, minInstancesPerNode=1, seed=2))
    x = np.stack([r["features"].toArray() for r in model.transform(prepared.frame).select("features").limit(40).collect()])
    trees = A.tree_leaves(model.stages[-1])
    phi = A.tree_shapley(trees, x)
    assert np.allclose(phi.sum(axis=1) + trees[0].expected(), A.tree_values(trees, x), atol=1e-9)
    want, _ = all_subsets(model.stages[-1], x[0])
    assert np.abs(phi[0] - want).max() < 1e-9


def test_slots_sum_to_raw_columns(prepared):
    model = fitted(prepared, GBTClassifier(maxIter=3, maxDepth=3, seed=1))
    slots = A.slot_columns(model)
    assert [s for s, _ in slots] == [*prepared.numeric, *prepared.categorical]
    assert sum(n for _, n in slots) == len(model.transform(prepared.frame).first()["features"])
    ex = A.Explainer.fit(model, prepared.frame)
    for r in ex.contributions(prepared.frame).limit(50).collect():
        margin = math.log(r["p"] / (1 - r["p"]))
        assert abs(sum(c["raw"] for c in r["contributions"]) + ex.base_value - margin) < 1e-8


def test_linear_equals_coefficients(prepared):
    model = fitted(prepared, LogisticRegression(regParam=0.01))
    ex = A.Explainer.fit(model, prepared.frame)
    vectors = {r["id"]: r["features"].toArray() for r in model.transform(prepared.frame).select("id", "features").collect()}
    mean = np.mean(list(vectors.values()), axis=0)
    coef = model.stages[-1].coefficients.toArray()
    for r in ex.contributions(prepared.frame).collect():
        terms = list(coef * (vectors[r["id"]] - mean))
        want = [sum(terms.pop(0) for _ in range(n)) for _, n in ex.slots]
        assert np.allclose([c["raw"] for c in r["contributions"]], want, atol=1e-9)


def test_explanation_has_ranked_points_and_one_stage(prepared):
    for estimator, method in ((GBTClassifier(maxIter=3, seed=1), "shap_tree"), (LogisticRegression(), "shap_linear")):
        ex = A.Explainer.fit(fitted(prepared, estimator), prepared.frame)
        out = ex.explain(prepared.frame, "id", 3)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        for r in out.collect():
            sizes = [(-abs(f["contribution"]), f["feature"]) for f in r["factors"]]
            assert r["method"] == method and sizes == sorted(sizes) and [f["rank"] for f in r["factors"]] == [1, 2, 3]
            gap = abs(r["risk_score"] - 50) or 1.0
            assert sum(abs(f["contribution"]) for f in r["factors"]) <= gap + 0.1
    with pytest.raises(ValueError):
        ex.explain(prepared.frame, "id", 0)
    with pytest.raises(ValueError):
        A.Explainer.fit(fitted(prepared, NaiveBayes(modelType="gaussian")), prepared.frame)


def test_points():
    """F6 on one row for a score above, below and at 50, and without any contribution."""
    from attrix.session import build_session
    spark = build_session("local[4]")
    item = "array<struct<feature: string, value: string, raw: double>>"
    df = spark.createDataFrame([(80.0, [("a", "1", 1.0), ("b", "2", -3.0)]), (50.0, [("a", "1", 1.0), ("b", "2", -3.0)]), (20.0, [("a", "1", 0.0)])], f"s double, c {item}")
    got = [[c["points"] for c in r["c"]] for r in df.select(A.in_points("c", "s").alias("c")).collect()]
    assert got == [[7.5, -22.5], [0.25, -0.75], [0.0]]
    assert df.where(F.lit(False)).select(A.in_points("c", "s")).collect() == []
