"""Explanation properties, chunking, search edge cases, sources, registry, streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from attrix.operators import explain as X
from attrix.operators import registry as J
from attrix.operators import retrieve as K
from attrix.operators import simulate as S
from attrix.sources import files as A
from conftest import SF_SMALL


def test_sampled_shapley_sums_to_prediction_gap(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, -1.0, 3.0), (3, 0.5, 0.5)], "id long, a double, b double")
    scorer = S.expression_scorer("0.3 * a - 0.7 * b + 0.2 * a * b")
    bg = {"a": 0.0, "b": 0.0}
    sh = X.sampled_shapley(df, "id", ["a", "b"], bg, scorer, n_perm=6)
    tot = {r["id"]: r["s"] for r in sh.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    p = {r["id"]: r["p"] * 100 for r in scorer(df).collect()}
    p0 = scorer(spark.createDataFrame([(0.0, 0.0)], "a double, b double")).first()["p"] * 100
    for k in tot:
        assert abs(tot[k] - (p[k] - p0)) < 1e-9


def test_points_scaling_zero_and_fifty(spark):
    c = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 0.2), (2, "b", -0.2)], "id long, feature string, raw double")
    s = spark.createDataFrame([(1, 80.0), (2, 50.0)], "id long, risk_score double")
    out = {(r["id"], r["feature"]): r["contribution"] for r in X.scale_to_points(c, "id", s).collect()}
    assert out[(1, "a")] == 0.0 and out[(2, "a")] == 0.5 and out[(2, "b")] == -0.5


def test_top_k_rejects_zero(spark):
    c = spark.createDataFrame([(1, "a", 1.0)], "id long, feature string, contribution double")
    with pytest.raises(ValueError):
        X.top_k(c, "id", 0)


def test_feature_label(spark):
    df = spark.createDataFrame([("num__NumOfProducts",), ("\ufeffis_active_member",)], "n string")
    assert [r[0] for r in df.select(X.label_expr(F.col("n"))).collect()] == ["Num Of Products", "Is active member"]


def test_chunking_headings_and_long_sections(spark):
    long_para = ("mot " * 300).strip()
    text = "intro line\n# Titre A\ncorps A\n## sous-titre\nsuite A\n# \nvide titre\n# Long\n" + \
        "\n\n".join([long_para] * 3)
    df = spark.createDataFrame([("doc.md", text)], "source string, text string")
    chunks = K.chunk_documents(df).orderBy("section", "piece").collect()
    titles = [c["title"] for c in chunks]
    assert titles[:3] == ["doc.md", "Titre A", "doc.md"]
    assert "## sous-titre" in chunks[1]["text"]
    assert all(len(c["text"]) <= 1600 for c in chunks if c["title"] == "Long")
    assert sum(1 for c in chunks if c["title"] == "Long") == 3


def test_blank_query_returns_nothing(spark):
    chunks = K.with_chunk_ids(K.chunk_documents(spark.createDataFrame(
        [("a", "churn client contrat"), ("b", "autre texte sans rapport")], "source string, text string")))
    post, vocab = K.build_index(chunks)
    q = spark.createDataFrame([(1, "   "), (2, "contrat client")], "qid long, text string")
    hits = K.search(q, post, vocab).collect()
    assert {h["qid"] for h in hits} == {2}
    assert hits[0]["chunk_id"].startswith("a:")


def test_reader_dispatch_and_sniffing(spark):
    d = tempfile.mkdtemp(prefix="attrix-test-")
    p1 = os.path.join(d, "semi.csv")
    with open(p1, "wb") as f:
        f.write("﻿ Nom ;Ville ; Solde\nDupré;Besançon;1,5\nMüller;Köln;2\n".encode("utf-8"))
    df = A.read_dataset(spark, p1)
    assert df.columns == ["Nom", "Ville", "Solde"]
    assert [r["Ville"] for r in df.collect()] == ["Besançon", "Köln"]
    p2 = os.path.join(d, "latin.csv")
    with open(p2, "wb") as f:
        f.write("nom,prix\nCafé,3\nEuro \x80,4\n".encode("latin-1"))
    df2 = A.read_dataset(spark, p2).collect()
    assert df2[0]["nom"] == "Café" and df2[1]["nom"] == "Euro €"
    with pytest.raises(ValueError):
        A.read_dataset(spark, os.path.join(d, "x.xlsx"))
    with pytest.raises(FileNotFoundError):
        A.read_dataset(spark, os.path.join(d, "missing.csv"))


def test_registry_rules(spark):
    v = spark.createDataFrame([("Exited", "bank.csv"), ("Churn", "assurance_clients.csv"), ("Lapse", ""), ("", "")],
                              "target string, dataset string")
    got = [r[0] for r in v.select(J.model_label(F.col("target"), F.col("dataset"))).collect()]
    assert got == ["Banque - Churn client", "Assurance Clients (Churn)", "Prediction Lapse", "Modele"]
    versions = spark.createDataFrame([("v1", "u1"), ("v2", "u1"), ("v3", "u2")], "version string, username string")
    acts = spark.createDataFrame([("u1", "v1", "2024-01-01 00:00:00")], "scope string, version string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    cur = J.current_versions(acts)
    req = spark.createDataFrame([("v1",), ("v2",), ("v9",)], "version string")
    out = {r["version"]: r["outcome"] for r in J.delete_versions(req, versions, cur).collect()}
    assert out == {"v1": "refused_active", "v2": "deleted", "v9": "not_found"}
    assert {r["scope"]: r["version"] for r in J.backfill_active(versions, cur).collect()} == {"u2": "v3"}


def test_stream_equals_batch(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    a = sorted(tuple(r) for r in qs["stream_score"](spark, SF_SMALL).collect())
    b = sorted(tuple(r) for r in qs["scored_levels"](spark, SF_SMALL).select("CustomerId", "risk_score", "risk_level").collect())
    assert a == b


def test_adaboost_beats_chance(spark):
    from attrix.operators.train import adaboost, adaboost_scores
    from attrix.operators.evaluate import roc_auc
    from attrix.sources import fixtures
    df = fixtures.churn(spark, SF_SMALL)
    model = adaboost(df, ["Age", "IsActiveMember", "NumOfProducts"], "Exited", rounds=5, checkpoint_every=2)
    assert 1 <= len(model.stumps) <= 5
    auc = roc_auc(adaboost_scores(df, model), "Exited", "p").first()["auc"]
    assert auc > 0.6


def test_knn_is_exact_against_brute_force(spark):
    import random
    import math
    from attrix.operators.neighbors import knn
    rnd = random.Random(7)
    pts = [(i, (round(rnd.gauss(0, 1), 3), round(rnd.gauss(0, 3), 3), float(rnd.randint(0, 2)))) for i in range(300)]
    pts += [(300 + i, (0.0, 0.0, 1.0)) for i in range(40)]           # a hot duplicated vector
    df = spark.createDataFrame([(i, *v) for i, v in pts], "id long, a double, b double, c double")
    # Also queries off the points, whose neighbourhood holds no reference point at first.
    qs = pts[::17] + [(900, (3.0, -9.0, 2.0)), (901, (-40.0, 55.0, 0.0)), (902, (0.5, 30.0, 9.0))]
    qdf = spark.createDataFrame([(i, *v) for i, v in qs], "id long, a double, b double, c double")
    out = knn(qdf, df, ["a", "b", "c"], 7, "id", "id", target_per_cell=8).collect()
    brute = {i: sorted(math.dist(v, w) for _, w in pts)[:7] for i, v in qs}
    for r in out:
        ds = []
        for n in r["neighbours"]:
            ds += [n["dist"]] * n["cnt"]
        assert [round(x, 9) for x in ds[:7]] == [round(x, 9) for x in brute[r["id"]]]
    assert len(out) == len(qs)


def test_smote_reaches_parity_within_bounds(spark):
    from attrix.operators.neighbors import smote
    rows = [(i, float(i % 10), float(i % 7), 0) for i in range(60)] + [(100 + i, 50.0 + i, 20.0 - i, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    out = smote(df, "label", "id", ["x", "y"], k=5)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1] == 60
    b = out.where("label = 1").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert b[0] >= 50.0 and b[1] <= 61.0 and b[2] >= 9.0 and b[3] <= 20.0


def _broadcast_subtrees(plan: str):
    """Text of every subtree under a BroadcastExchange node of a tree-string plan."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line or "ReusedExchange" in line:
            continue
        depth = line.index("BroadcastExchange")
        sub = []
        for nxt in lines[i + 1:]:
            stripped = nxt.lstrip(" :+-")
            if not stripped or len(nxt) - len(stripped) <= depth:
                break
            sub.append(nxt)
        out.append("\n".join(sub))
    return out


def test_search_never_broadcasts_the_corpus(spark):
    """Scale guard: only the query side (bounded, counted) may be broadcast; nothing derived
    from the documents table (term frequencies, norms) goes into a broadcast."""
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    df = entry.queries()["tfidf_search"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    subtrees = _broadcast_subtrees(plan)
    assert subtrees, "the query-term vectors should be broadcast"
    assert not any("documents.parquet" in s for s in subtrees)
