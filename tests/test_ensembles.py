"""Own ensembles: growth against plain evaluation, statistics without leaks, training with them."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from attrix.operators import ensembles as N
from attrix.operators import evaluate as E
from attrix.operators import train as T


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, c, g = rng.gauss(0, 1), rng.randint(0, 4), rng.choice("uvwxyz")
        rows.append((i, a, float(c), g, int(a * (1 if g in "uvw" else -1) + 0.4 * c + rng.gauss(0, 0.4) > 0.8)))
    df = spark.createDataFrame(rows, "id long, a double, c double, g string, y int")
    prep = T.prepare(df, "y", ids=["id"], leaks=[], key="id")
    split = E.stratified_split(prep.frame, "label", "id").cache()
    return prep, split.where("not is_test"), split.where("is_test")


def auc(prepared, estimator):
    prep, train, test = prepared
    model = Pipeline(stages=[*[s.copy() for s in prep.stages], estimator]).fit(train)
    scored = T._proba(model, test)
    assert scored.where("p < 0 or p > 1 or p is null").count() == 0 and scored.count() == test.count()
    return T.evaluate_predictions(scored)["auc"]


def test_own_ensembles_learn(prepared):
    least = auc(prepared, T.GBTClassifier(maxIter=15, maxDepth=3, seed=1)) - 0.03
    assert auc(prepared, N.LeafwiseBoosting(rounds=12, rate=0.3, leaves=8, depth=4)) >= least
    assert auc(prepared, N.ExtraTrees(trees=40, depth=8)) >= least - 0.05
    assert auc(prepared, N.NearestNeighbours(k=9)) > 0.7
    assert auc(prepared, N.AdaBoostStumps(rounds=20)) > 0.6


def test_target_statistics_learn_without_seeing_the_own_target(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"only{i}", float(i % 3), float(rng.randint(0, 1))) for i in range(300)], "g string, a double, label double")
    df = T.VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    _, train = N.ordered_statistics(df, ["g"])
    mean = df.agg(F.avg("label")).first()[0]
    assert all(abs(r["__x"][1] - mean) < 1e-12 for r in train.collect())   # every category is alone: nothing came before
    same = df.withColumn("g", F.lit("one"))
    inputs, train = N.ordered_statistics(same, ["g"])
    rows = train.collect()
    order = [r["__h"] for r in same.select(F.xxhash64(F.array("a"), "g").alias("__h")).collect()]
    assert len(rows) == 300 and len(order) == 300
    first = min(rows, key=lambda r: abs(r["__x"][1] - mean))
    assert abs(first["__x"][1] - mean) < 1e-12
    total = sum(r["label"] for r in rows)
    assert all(abs(r["__x"][1] - (total + 10 * mean) / 310) < 1e-12 for r in inputs(same).collect())
    assert inputs(same.withColumn("g", F.lit("new"))).first()["__x"][1] == pytest.approx(mean)


def plain_level_gain(x, g, h, shrink):
    """The best first split by trying every cut."""
    def score(on):
        return g[on].sum() ** 2 / (h[on].sum() + shrink)
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = score(left) + score(~left) - score(np.ones(len(x), bool))
            if gain > best[0] + 1e-12:
                best = (gain, j, cut)
    return best


def test_first_split_is_the_best_cut(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (200, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 2, 200) > 6).astype(float)
    df = T.VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(
        spark.createDataFrame([(*r, v) for r, v in zip(x.tolist(), y.tolist())], "a double, b double, c double, d double, label double"))
    stage = N.LeafwiseBoosting(rounds=1, rate=1.0, leaves=2, depth=1)
    model = stage.fit(df)
    p = y.mean()
    _, j, cut = plain_level_gain(x, p - y, np.full(200, p * (1 - p)), 1.0)
    left = x[:, j] <= cut
    start = np.log(p / (1 - p))
    leaf = lambda on: -((p - y[on]).sum()) / (on.sum() * p * (1 - p) + 1.0)
    want = 1 / (1 + np.exp(-(start + np.where(left, leaf(left), leaf(~left)))))
    got = np.array([r["probability"][1] for r in model.transform(df).collect()])
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-12)


def test_best_first_takes_the_largest_gains():
    tree = N.Tree()
    a, b = tree.split(0, 0, 1.0)
    c, d = tree.split(a, 1, 2.0)
    e, f = tree.split(b, 2, 3.0)
    tree.split(e, 3, 4.0)
    gains = {0: 1.0, a: 2.0, b: 5.0, e: 9.0}
    values = {k: float(k) for k in range(9)}
    small = N.best_first(tree, gains, values, 4)
    assert sorted(f for f in small.feature if f >= 0) == [0, 2, 3] and len([f for f in small.feature if f < 0]) == 4
    assert small.predict(np.array([[0.0, 9, 0, 0], [2.0, 0, 9, 0], [2.0, 0, 0, 9], [2.0, 0, 0, 0]])).tolist() == [a, f, 8.0, 7.0]


def test_one_class_and_oversampled_vectors(spark, prepared):
    prep, train, _ = prepared
    vectors = Pipeline(stages=prep.stages).fit(train).transform(train)
    ones = vectors.where("label = 1")
    for stage in (N.LeafwiseBoosting(rounds=2), N.ExtraTrees(trees=3)):
        assert {round(r["probability"][1], 9) for r in stage.fit(ones).transform(ones).collect()} == {1.0}
    few = train.where("label = 0 or id % 5 = 0")
    model = T.fit_balanced(prep.stages, T.LogisticRegression(maxIter=20), few, "smote", "id")
    assert model.transform(train).count() == train.count()


def test_catalogue_is_complete():
    from attrix.session import build_session
    build_session("local[4]")
    assert len(T.catalogue(True)) == 5 and len(T.catalogue(False)) == 11


def test_adaboost_rounds_keep_a_row_a_row(spark, monkeypatch):
    """A round counts by arrays: no row becomes one row per feature; rows without a label have no mass."""
    from attrix.operators import train as T

    def refuse(*_):
        raise AssertionError("rows are multiplied")

    df = spark.createDataFrame([(float(i), float(i % 4), None if i == 5 else int(i > 20)) for i in range(40)], "a double, b double, y int")
    monkeypatch.setattr(T.F, "explode", refuse)
    model = T.adaboost(df, ["a", "b"], "y", rounds=5)
    feature, _, polarity, alpha = model.stumps[0]
    assert (feature, polarity) == (0, 1) and alpha == pytest.approx(math.log(38))   # no edge of a bin is at 20: one of 39 rows is wrong


def test_boosting_reads_stored_rows_in_few_tasks(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from attrix.operators import train as T

    seen = []
    fit = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, x: seen.append((x.rdd.getNumPartitions(), x._jdf.queryExecution().optimizedPlan().toString())) or fit(self, x))
    df = spark.range(60).selectExpr("id", "cast(id as double) a", "cast(id > 30 as double) label").repartition(7)
    T.fit_balanced([VectorAssembler(inputCols=["a"], outputCol="features")], GBTClassifier(maxIter=2), df, None, "id")
    partitions, plan = seen[0]
    assert partitions == 1 and "LogicalRDD" in plan and "Repartition 7" not in plan
