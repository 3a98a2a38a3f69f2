"""Exact neighbours on mixed vectors against brute force, and how little is compared."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.operators import boxes
from attrix.operators.neighbors import knn, knn_predict


def mixed(n, seed, groups=6):
    """Numbers beside one-hot slots; some vectors are repeated."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.1:
            out.append((i, list(rng.choice(out)[1]), rng.randint(0, 1)))
            continue
        g = rng.randrange(groups)
        out.append((i, [round(rng.gauss(0, 1), 2) for _ in range(3)] + [float(g == j) for j in range(groups)], rng.randint(0, 1)))
    return out


def brute(rows, q, need):
    """Vectors by distance, then least id, until they cover the wanted number of points."""
    seen = {}
    for i, v, y in rows:
        first, n, s = seen.get(tuple(v), (i, 0, 0))
        seen[tuple(v)] = min(first, i), n + 1, s + y
    out, have = [], 0
    for d, i, n, s in sorted((round(math.dist(v, q), 9), i, n, s) for v, (i, n, s) in seen.items()):
        if have >= need:
            break
        out.append((d, i, n, s))
        have += n
    return out


@pytest.mark.parametrize("n, need, per_leaf", [(400, 7, 8), (400, 1, 32), (30, 50, 4), (1, 3, 8)])
def test_equal_to_brute_force(spark, monkeypatch, n, need, per_leaf):
    monkeypatch.setattr(boxes, "PIECE", 20)
    monkeypatch.setattr(boxes, "QUERIES", 9)
    rows, asked = mixed(n, 1), mixed(40, 2)
    refs = spark.createDataFrame([(i, v, y) for i, v, y in rows], "id long, v array<double>, y int")
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked] + [(100, [9.0] * 9), (101, rows[0][1])], "id long, v array<double>")
    got = knn(queries, refs, ["v"], need, "id", "id", label="y", target_per_cell=per_leaf).collect()
    assert len(got) == 42
    vectors = {r["id"]: r["v"] for r in queries.collect()}
    for r in got:
        assert [(round(x["dist"], 9), x["rid"], x["cnt"], x["lsum"]) for x in r["neighbours"]] == brute(rows, vectors[r["id"]], need)


def test_not_all_pairs_are_compared(spark):
    rng = np.random.default_rng(3)
    group = rng.integers(0, 20, 4000)
    x = np.concatenate([rng.normal(size=(4000, 3)), np.eye(20)[group]], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], "rid long, v array<double>, cnt long, lsum double")
    found, pairs = boxes.nearest(df.where("rid % 10 = 0").select(F.col("rid").alias("qid"), F.col("v").alias("qv")), df, 15)
    assert found.count() == 400 and pairs.first()[0] < 0.5 * 400 * 4000


def test_equal_vectors_and_no_reference(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(500)], "id long, v array<double>, y int")
    assert [r["p"] for r in knn_predict(df.limit(3), df, ["v"], "y", 15, "id", "id").collect()] == [0.5] * 3
    assert knn(df, df.limit(0), ["v"], 3, "id", "id").collect() == []
    with pytest.raises(ValueError):
        knn(df, df.withColumn("v", F.lit(None).cast("array<double>")), ["v"], 3, "id", "id")


def test_tree_covers_every_vector():
    x = np.array([[0.0, 0.0]] * 50 + [[1.0, 0.0]] * 2 + [[float(k), 5.0] for k in range(60)])
    tree = boxes.Tree(x, 4)
    leaf = tree.leaf_of(x)
    assert set(leaf) == set(range(tree.leaves)) and (np.bincount(leaf)[leaf[50:52]] <= 4).all()


def test_pieces_are_compared_as_arrow_tables(spark, monkeypatch):
    """Lists of neighbours are taken from columns; a group that goes through Python objects would fail here."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from attrix.operators.boxes import nearest

    def refuse(*_):
        raise AssertionError("rows became objects")

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", refuse)
    refs = spark.createDataFrame([([float(i), float(i % 3)], i, 1 + i % 2, 1.0) for i in range(40)], "v array<double>, rid long, cnt long, lsum double")
    queries = spark.createDataFrame([(7, [3.2, 0.0]), (8, [39.0, 1.0])], "qid long, qv array<double>")
    got = {r["qid"]: [n["rid"] for n in r["nbrs"]] for r in nearest(queries, refs, 3, 4)[0].collect()}
    want = {}
    for q, (x, y) in ((7, (3.2, 0.0)), (8, (39.0, 1.0))):
        order, total, want[q] = sorted(range(40), key=lambda i: (round(((i - x) ** 2 + (i % 3 - y) ** 2) ** 0.5, 9), i)), 0, []
        for i in order:
            if total < 3:
                want[q].append(i)
                total += 1 + i % 2
    assert got == want
