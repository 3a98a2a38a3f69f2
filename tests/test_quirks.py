"""Golden rows and properties for the semantic decisions."""

import math

from pyspark.sql import functions as F

from attrix.operators import drift as D
from attrix.operators import evaluate as E
from attrix.operators import recommend as I
from attrix.operators import simulate as S
from attrix.operators import views as V
from attrix.operators.clean import apply_clipper, fit_clipper
from attrix.operators.score import risk_score
from attrix.functions.scalars import mask_email, email_valid, safe_slug, score_percent, ascii_slug


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.0125,), (0.0135,), (0.5,), (0.71449,)], "p double")
    got = [r[0] for r in df.select(risk_score("p")).collect()]
    # numpy: np.round(p * 100, 1)
    assert got == [1.2, 1.4, 50.0, 71.4]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "s double")
            .select(score_percent("s")).collect()] == ["2%", "4%"]


def test_distribution_and_histogram_sum_to_total(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 29.9, 30, 70, 70.1, 99.9, 100, 55.5]], "risk_score double")
    dist = {r["key"]: r["count"] for r in V.risk_distribution(df).collect()}
    assert dist == {"faible": 2, "moyen": 3, "eleve": 3}
    hist = V.risk_histogram(df).collect()
    assert len(hist) == 10 and sum(r["count"] for r in hist) == 8
    assert [r["count"] for r in hist][9] == 2          # [90, 100.1) holds 99.9 and 100


def test_pages_concatenate_to_sorted_list(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(23)], "id long, risk_score double")
    full = [r["id"] for r in df.orderBy(F.col("risk_score").desc(), "id").collect()]
    pages = []
    for off in range(0, 23, 5):
        p = V.page(df, off, 5, id_col="id").collect()
        assert all(r["total"] == 23 for r in p)
        pages += [r["id"] for r in p]
    assert pages == full


def test_kpis_empty_table(spark):
    df = spark.createDataFrame([], "risk_score double")
    r = V.dashboard_kpis(df).first()
    assert (r["total"], r["at_risk_pct"], r["avg_churn_rate"], r["avg_score"]) == (0, 0.0, 0.0, 0.0)


def test_psi_of_identical_data_is_zero_and_shares_sum_to_one(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(200)], "x double, c string")
    ref = D.build_reference(df, ["x", "c"])
    sums = {r["column"]: r["s"] for r in ref.groupBy("column").agg(F.sum("proportion").alias("s")).collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    psi = {r["column"]: r["psi"] for r in D.psi_by_column(df, ref).collect()}
    assert psi == {"x": 0.0, "c": 0.0}


def test_collapsed_edges_give_single_bin(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 2 + [(3.0,)], "x double")
    ref = D.build_reference(df, ["x"])
    assert ref.count() >= 1
    new = spark.createDataFrame([(9.0,)] * 10, "x double")
    r = D.psi_by_column(new, ref).first()
    assert r["psi"] >= 0


def test_unseen_category_raises_psi(spark):
    ref_df = spark.createDataFrame([("a",), ("b",)] * 50, "c string")
    new = spark.createDataFrame([("a",), ("z",)] * 50, "c string")
    r = D.psi_by_column(new, D.build_reference(ref_df, ["c"])).first()
    assert r["level"] == "fort"


def test_clipping_keeps_rows_and_is_idempotent(spark):
    df = spark.createDataFrame([(float(x),) for x in list(range(20)) + [500.0, -300.0]] + [(None,)], "v double")
    cb = fit_clipper(df, None)
    once = apply_clipper(df, cb)
    twice = apply_clipper(once, cb)
    assert once.count() == df.count()
    assert once.collect() == twice.collect()
    assert once.where(F.col("v").isNull()).count() == 1


def test_class_rank_equals_row_number(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "k long, y boolean").withColumn(
        "y", F.col("y").cast("int"))
    got = {r["k"]: r["class_rank"] for r in E.class_rank(df, "y", "k").collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("y").orderBy(E.hash_order("k"))
    exp = {r["k"]: r["rn"] for r in df.select("k", F.row_number().over(w).alias("rn")).collect()}
    assert got == exp


def test_auc_with_ties_matches_rank_sum(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.2), (0, 0.7), (1, 0.5), (0, 0.5), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = E.roc_auc(df, "y", "s").first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, brute)


def test_reply_parsing_and_validation(spark):
    replies = [
        ("fenced", '```json\n[{"action": "Appeler", "detail": "d", "priority": "haute", "impact": 35.7}]\n```'),
        ("no_action", '[{"detail": "x"}, {"action": "", "priority": "Basse"}]'),
        ("bad_prio", '[{"action": "A", "priority": "urgent", "impact": "x"}]'),
        ("not_json", "Voici mes conseils : appeler le client."),
        ("second_kept", '[{"detail": "skip"}, {"action": "B", "impact": -3}]'),
    ]
    df = spark.createDataFrame(replies, "k string, reply string")
    out = {r["k"]: r["v"] for r in df.select("k", I.validate_actions(I.parse_replies("reply")).alias("v")).collect()}
    assert out["fenced"][0]["priority"] == "Haute" and out["fenced"][0]["impact"] == 20
    assert out["no_action"] is None and out["not_json"] is None
    assert out["bad_prio"][0]["priority"] == "Moyenne" and out["bad_prio"][0]["impact"] == 5
    assert out["second_kept"][0]["id"] == "r_ia_expert_1" and out["second_kept"][0]["impact"] == 0


def test_validation_messages(spark):
    feats = [{"name": "Age", "type": "numerique"},
             {"name": "Geo", "type": "categoriel", "values": ["France", "Spain"]},
             {"name": "Active", "type": "booleen", "values": ["0", "1"]}]
    df = spark.createDataFrame([("40", "France", "1"), ("x", "Italy", ""), (None, "Spain", "0")],
                               "Age string, Geo string, Active string")
    out = S.validate(df, feats, {"Active": "int"}).select("valid", S.error_text().alias("e")).collect()
    assert out[0]["valid"] and out[0]["e"] == ""
    assert out[1]["e"] == ("« Age » doit être un nombre. ; « Geo » : valeur 'Italy' non autorisée "
                           "(attendu : ['France', 'Spain']). ; Champ requis manquant : Active")
    assert out[2]["e"] == "Champ requis manquant : Age"


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("jean.dupont@exemple.com",), ("ab@x.fr",), ("bad@",)], "e string")
    r = df.select(mask_email("e").alias("m"), email_valid("e").alias("v"), safe_slug("e").alias("s")).collect()
    assert r[0]["m"] == "j*********t@exemple.com" and r[1]["m"] == "a*@x.fr"
    assert [x["v"] for x in r] == [True, True, False]
    assert spark.createDataFrame([("Élodie Dupré",)], "n string").select(ascii_slug("n")).first()[0] == "elodiedupre"


def test_type_inference_dates_and_booleans(spark):
    from attrix.operators.profile import build_profile
    rows = [(f"2024-01-{(i % 28) + 1:02d}", "oui" if i % 2 else "non", f"Jan {i % 28 + 1}, 2024", i, float(i) / 3)
            for i in range(40)]
    df = spark.createDataFrame(rows, "d1 string, flag string, d2 string, n long, x double")
    types = {c["name"]: c["type"] for c in build_profile(df).columns}
    assert types == {"d1": "date", "flag": "booleen", "d2": "date", "n": "numerique", "x": "numerique"}


def test_cell_text_matches_python_and_js_formatting(spark):
    """Exact-binary 2-decimal rounding (Python {:.2f}, JS toFixed), fr-FR grouping of
    integral numbers, NULL shown as a dash (cells) or empty (display text), never 'nu'."""
    from attrix.functions.scalars import display_value
    from attrix.operators.views import format_cell
    vals = [275814.235, 0.125, 1234.5, 12345.0, -9876543.0, None, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(format_cell("x", "double").alias("c"), display_value("x", "double").alias("d")).collect()
    nbsp = "\u202f"

    def js_cell(v):
        if v is None:
            return "—"
        if v == int(v):
            s = f"{abs(int(v)):,}".replace(",", nbsp)
            return ("-" if v < 0 else "") + s
        return f"{v:.2f}"

    def py_display(v):
        return "" if v is None else f"{v:.2f}".rstrip("0").rstrip(".")
    assert [r["c"] for r in got] == [js_cell(v) for v in vals]
    assert [r["d"] for r in got] == [py_display(v) for v in vals]
    assert got[0]["c"] == "275814.23"          # the double is below .235
