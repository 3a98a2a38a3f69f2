"""D-group queries: split, folds, metrics, AUC, CV summary, leaderboard, model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import train as T
from ..operators.stats import quantiles
from ..sources import fixtures
from .catalog import register
from .oracle_views import CHURN, SCORED, with_

TARGET, KEY = "Exited", "CustomerId"
_RANK = "row_number() OVER (PARTITION BY Exited ORDER BY md5(CAST(CustomerId AS VARCHAR) || '-42'))"


def _r9(df, cols):
    return df.withColumns({c: F.rint(F.col(c) * 1e9) / 1e9 for c in cols})


@register("stratified_split", with_(CHURN) + f"""
SELECT CustomerId, Exited, rn AS class_rank, rn <= floor((n * 20 + 99) / 100) AS is_test
FROM (SELECT CustomerId, Exited, {_RANK} AS rn, count(*) OVER (PARTITION BY Exited) AS n FROM churn)""")
def stratified_split(spark, sf):
    s = E.stratified_split(fixtures.churn(spark, sf), TARGET, KEY)
    return s.select(KEY, TARGET, "class_rank", "is_test")


@register("fold_assignment", with_(CHURN) + f"""
SELECT CustomerId, Exited, CAST(({_RANK} - 1) % 3 AS INTEGER) AS fold FROM churn""")
def fold_assignment(spark, sf):
    return E.assign_folds(fixtures.churn(spark, sf), TARGET, KEY, 3).select(KEY, TARGET, "fold")


_FOLDED = with_(SCORED) + f""",
fs AS (SELECT *, CAST(({_RANK} - 1) % 3 AS INTEGER) AS fold, CAST(p >= 0.5 AS INTEGER) AS pred FROM scored)"""


def _folded(spark, sf):
    s = fixtures.scored(spark, sf)
    return E.assign_folds(s, TARGET, KEY, 3).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


_CONF_SQL = """
SELECT fold, tp, fp, fn, tn,
       round_even(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) * 1e9, 0) / 1e9 AS accuracy,
       round_even(coalesce(tp / nullif(tp + fp, 0), 0.0) * 1e9, 0) / 1e9 AS precision,
       round_even(coalesce(tp / nullif(tp + fn, 0), 0.0) * 1e9, 0) / 1e9 AS recall,
       round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) * 1e9, 0) / 1e9 AS f1
FROM (SELECT fold, count(*) FILTER (WHERE Exited = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE Exited <> 1 AND pred = 1) AS fp,
             count(*) FILTER (WHERE Exited = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE Exited <> 1 AND pred <> 1) AS tn
      FROM fs GROUP BY fold)"""


@register("confusion_metrics", _FOLDED + _CONF_SQL)
def confusion_metrics(spark, sf):
    c = E.confusion(_folded(spark, sf), TARGET, "pred", ["fold"])
    return _r9(c, ["accuracy", "precision", "recall", "f1"])


_AUC_CTE = """,
ranked AS (SELECT fold, Exited, avg(r) OVER (PARTITION BY fold, p) AS ar FROM
           (SELECT fold, Exited, p, rank() OVER (PARTITION BY fold ORDER BY p) + 0.0 AS r0,
                   row_number() OVER (PARTITION BY fold ORDER BY p) AS r FROM fs)),
auc AS (SELECT fold, count(*) FILTER (WHERE Exited = 1) AS n_pos, count(*) FILTER (WHERE Exited <> 1) AS n_neg,
               (sum(ar) FILTER (WHERE Exited = 1) - count(*) FILTER (WHERE Exited = 1) * (count(*) FILTER (WHERE Exited = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE Exited = 1) * count(*) FILTER (WHERE Exited <> 1)) AS auc
        FROM ranked GROUP BY fold)"""


@register("roc_auc_exact", _FOLDED + _AUC_CTE + """
SELECT fold, n_pos, n_neg, round_even(auc * 1e9, 0) / 1e9 AS auc FROM auc""")
def roc_auc_exact(spark, sf):
    a = E.roc_auc(_folded(spark, sf), TARGET, "p", ["fold"])
    return _r9(a, ["auc"])


@register("cv_summary", _FOLDED + _AUC_CTE + """,
conf AS (""" + _CONF_SQL + """),
m AS (SELECT c.fold, a.auc, c.f1, c.accuracy FROM conf c JOIN auc a ON c.fold = a.fold)
SELECT round_even(avg(auc) * 1e9, 0) / 1e9 AS auc_mean, round_even(stddev_pop(auc) * 1e9, 0) / 1e9 AS auc_std,
       round_even(avg(f1) * 1e9, 0) / 1e9 AS f1_mean, round_even(stddev_pop(f1) * 1e9, 0) / 1e9 AS f1_std,
       round_even(avg(accuracy) * 1e9, 0) / 1e9 AS accuracy_mean,
       round_even(stddev_pop(accuracy) * 1e9, 0) / 1e9 AS accuracy_std
FROM m""")
def cv_summary(spark, sf):
    f = _folded(spark, sf)
    per_fold = E.confusion(f, TARGET, "pred", ["fold"]).join(E.roc_auc(f, TARGET, "p", ["fold"]), "fold")
    s = E.cv_summary(per_fold, ["auc", "f1", "accuracy"])
    return _r9(s, s.columns)


# Candidate scorers compared on the test split (all read the customer table).
CANDIDATES = [
    ("logit_fixed", "p"),
    ("inactivity", "1.0 - IsActiveMember"),
    ("age", "Age / 100.0"),
    ("few_products", "1.0 / (1.0 + NumOfProducts)"),
    ("low_tenure", "1.0 / (1.0 + Tenure)"),
]


@register("leaderboard", with_(SCORED) + """,
sp AS (SELECT *, row_number() OVER (PARTITION BY Exited ORDER BY md5(CAST(CustomerId AS VARCHAR) || '-42')) AS rn,
              count(*) OVER (PARTITION BY Exited) AS n FROM scored),
te AS (SELECT * FROM sp WHERE rn <= floor((n * 20 + 99) / 100)),
cand AS (""" + "\nUNION ALL ".join(
    f"SELECT {i} AS ordinal, '{name}' AS model, Exited, CAST({expr} AS DOUBLE) AS s FROM te"
    for i, (name, expr) in enumerate(CANDIDATES)) + """),
r AS (SELECT ordinal, model, Exited, s, avg(rn2) OVER (PARTITION BY ordinal, s) AS ar
      FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY s) AS rn2 FROM cand)),
m AS (SELECT ordinal, model,
             (sum(ar) FILTER (WHERE Exited = 1) - count(*) FILTER (WHERE Exited = 1) * (count(*) FILTER (WHERE Exited = 1) + 1) / 2.0)
               / (count(*) FILTER (WHERE Exited = 1) * count(*) FILTER (WHERE Exited <> 1)) AS auc,
             count(*) FILTER (WHERE Exited = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE Exited <> 1 AND s >= 0.5) AS fp,
             count(*) FILTER (WHERE Exited = 1 AND s < 0.5) AS fn, count(*) FILTER (WHERE Exited <> 1 AND s < 0.5) AS tn
      FROM r GROUP BY ordinal, model),
f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
             coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy FROM m)
SELECT row_number() OVER (ORDER BY auc DESC, f1 DESC, ordinal) AS position, model,
       round_even(auc * 10000, 0) / 10000 AS test_roc_auc, round_even(f1 * 10000, 0) / 10000 AS test_f1,
       round_even(accuracy * 10000, 0) / 10000 AS test_accuracy,
       row_number() OVER (ORDER BY auc DESC, f1 DESC, ordinal) = 1 AS selected
FROM f""")
def leaderboard(spark, sf):
    s = E.stratified_split(fixtures.scored(spark, sf), TARGET, KEY).where("is_test")
    items = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("model"),
                               F.expr(e).cast("double").alias("s")) for i, (n, e) in enumerate(CANDIDATES)])
    long = s.select(TARGET, F.explode(items).alias("c")).select(TARGET, "c.*").withColumn(
        "pred", (F.col("s") >= 0.5).cast("int"))
    conf = E.confusion(long, TARGET, "pred", ["ordinal", "model"])
    auc = E.roc_auc(long, TARGET, "s", ["ordinal", "model"])
    board = E.select_best(conf.join(auc, ["ordinal", "model"]), "auc", "f1", "ordinal")
    r4 = lambda c: F.rint(F.col(c) * 10000) / 10000
    return board.select("position", "model", r4("auc").alias("test_roc_auc"), r4("f1").alias("test_f1"),
                        r4("accuracy").alias("test_accuracy"), "selected")


def _train_one(spark, sf, name):
    df = fixtures.churn(spark, sf)
    res = T.train_and_select(df, TARGET, KEY, ids=[KEY, "Surname"], leaks=[], models=[name], folds=3)
    return res.leaderboard


@register("trained_scores")
def trained_scores(spark, sf):
    """Train on a text target, then score the whole customer table with the fitted model: risk per level."""
    from pyspark.ml import Pipeline

    from ..functions.scalars import risk_level
    from ..operators.score import score_with_model
    df = fixtures.churn(spark, sf).withColumn(TARGET, F.when(F.col(TARGET) == 1, "Oui").otherwise("Non"))
    prep = T.prepare(df, TARGET, ids=[KEY, "Surname"], leaks=[], key=KEY)
    model = Pipeline(stages=[*prep.stages, T.catalogue(True, 1000)["Régression logistique"].copy().setMaxIter(50)]).fit(prep.frame)
    scored = score_with_model(prep.frame, model).withColumn("level", risk_level("risk_score"))
    return scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("left_share"))


@register("train_logreg")
def train_logreg(spark, sf):
    return _train_one(spark, sf, "Régression logistique")


@register("train_forest")
def train_forest(spark, sf):
    return _train_one(spark, sf, "Random Forest")


@register("train_gbt")
def train_gbt(spark, sf):
    return _train_one(spark, sf, "HistGradient Boosting")


@register("train_naive_bayes")
def train_naive_bayes(spark, sf):
    return _train_one(spark, sf, "Naive Bayes")


NUMERIC = ["Balance", "EstimatedSalary", "Age", "NumOfProducts", "Tenure", "IsActiveMember"]
CATEGORICAL = ["Geography", "Segment"]


def _preprocessed(spark, sf):
    """(customers, feature columns): all eight features, medians for nulls, standardised numbers, a column per category.

    Statistics come from one aggregate and one median; the categories are those of two small dimensions.
    """
    c = fixtures.churn(spark, sf)
    medians = quantiles(c, ["EstimatedSalary"], [0.5])["EstimatedSalary"][0]
    c = c.withColumn("EstimatedSalary", F.coalesce("EstimatedSalary", F.lit(medians[0] if medians else 0.0)))
    st = c.agg(*[F.avg(f).alias(f"m_{f}") for f in NUMERIC], *[F.stddev_pop(f).alias(f"s_{f}") for f in NUMERIC],
               *[F.array_sort(F.collect_set(f)).alias(f"v_{f}") for f in CATEGORICAL]).first()
    columns = {f: (F.col(f) - st[f"m_{f}"]) / (st[f"s_{f}"] or 1.0) for f in NUMERIC}
    columns |= {f"{f}_{i}": (F.col(f) == v).cast("double") for f in CATEGORICAL for i, v in enumerate(st[f"v_{f}"])}
    return c.select(KEY, TARGET, *[e.alias(n) for n, e in columns.items()]), list(columns)


_VECTORS_SQL = with_(CHURN) + f""",
filled AS (SELECT * REPLACE (coalesce(EstimatedSalary, (SELECT quantile_cont(EstimatedSalary, 0.5) FROM churn)) AS EstimatedSalary) FROM churn),
st AS (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in NUMERIC)} FROM filled),
x AS (SELECT CustomerId, Exited, {", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in NUMERIC)}, Geography, Segment,
             {_RANK} <= floor((count(*) OVER (PARTITION BY Exited) * 20 + 99) / 100) AS is_test FROM filled, st)"""


@register("knn_predict", _VECTORS_SQL + f""",
refs AS (SELECT {", ".join(NUMERIC + CATEGORICAL)}, min(CustomerId) AS rid, count(*) AS cnt, sum(Exited) AS lsum FROM x WHERE NOT is_test GROUP BY ALL),
d AS (SELECT q.CustomerId, q.Exited, r.rid, r.cnt, r.lsum, round_even(sqrt({" + ".join(f"(q.{f} - r.{f}) ^ 2" for f in NUMERIC)}
             + CASE WHEN q.Geography = r.Geography THEN 0 ELSE 2 END + CASE WHEN q.Segment = r.Segment THEN 0 ELSE 2 END) * 1e9, 0) AS dist
      FROM x q, refs r WHERE q.is_test),
near AS (SELECT *, sum(cnt) OVER (PARTITION BY CustomerId ORDER BY dist, rid) - cnt AS before FROM d),
u AS (SELECT *, least(cnt, 15 - before) AS use FROM near WHERE before < 15)
SELECT CustomerId, Exited, round_even(sum(use * lsum / cnt) / sum(use) * 1e9, 0) / 1e9 AS p FROM u GROUP BY CustomerId, Exited""")
def knn_predict(spark, sf):
    """k = 15 nearest training customers (exact, all features) for every test customer."""
    from ..operators.neighbors import knn_predict as kp
    full, features = _preprocessed(spark, sf)
    s = E.stratified_split(full, TARGET, KEY)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    p = kp(test, train, features, TARGET, 15, KEY, KEY)
    return p.join(test.select(KEY, TARGET), KEY).select(KEY, TARGET, (F.rint(F.col("p") * 1e9) / 1e9).alias("p"))


@register("smote")
def smote(spark, sf):
    """Minority customers oversampled to parity on the training split."""
    from ..operators.neighbors import smote as sm
    full, features = _preprocessed(spark, sf)
    s = E.stratified_split(full, TARGET, KEY).where(~F.col("is_test")).drop("class_rank", "class_n", "is_test")
    out = sm(s, TARGET, KEY, features, k=5)
    return out.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 6).alias(f"mean_{f}") for f in NUMERIC])


@register("adaboost")
def adaboost(spark, sf):
    """SAMME AdaBoost of 200 stumps trained on the train split; test AUC."""
    full, features = _preprocessed(spark, sf)
    s = E.stratified_split(full, TARGET, KEY)
    model = T.adaboost(s.where(~F.col("is_test")), features, TARGET, rounds=200)
    test = T.adaboost_scores(s.where(F.col("is_test")), model)
    auc = E.roc_auc(test, TARGET, "p")
    return auc.select("n_pos", "n_neg", F.rint(F.col("auc") * 1e9) / 1e9, F.lit(len(model.stumps)).alias("rounds"))
