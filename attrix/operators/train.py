"""Preprocessing, model catalogue, training and selection with MLlib.

Every fit is a distributed MLlib job; the driver only loops over (model, fold)
pairs, like the reference's bounded-parallel loop. The prepared training frame is
persisted once (MEMORY_AND_DISK, recomputed from lineage on executor loss) and
reused by every fit and every evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import evaluate as E
from .ensembles import AdaBoostStumps, ExtraTrees, LeafwiseBoosting, NearestNeighbours, _cells, _summed
from .clean import add_features, clean, encode_target, imbalance, split_columns

SEED = 42
#: Rows of a task of a boosting round: a round is a few small jobs, so its time is that of its tasks' starts.
BOOST_ROWS = 25_000


def preprocessor(numeric: list[str], categorical: list[str]) -> list:
    """Median impute + standardise numerics; index (unseen kept) + one-hot categoricals.

    ``handleInvalid="keep"`` puts unseen/NULL categories in the extra last index and
    ``dropLast=True`` drops exactly that slot, so they encode as all zeros.
    """
    stages = []
    num_out = []
    if numeric:
        imp = [f"__imp_{c}" for c in numeric]
        stages.append(Imputer(inputCols=numeric, outputCols=imp, strategy="median"))
        stages.append(VectorAssembler(inputCols=imp, outputCol="__num_raw", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num_raw", outputCol="__num", withMean=True, withStd=True))
        num_out = ["__num"]
    cat_out = []
    if categorical:
        idx = [f"__idx_{c}" for c in categorical]
        ohe = [f"__ohe_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="keep"))
        cat_out = ohe
    stages.append(VectorAssembler(inputCols=num_out + cat_out, outputCol="features"))
    return stages


def catalogue(fast: bool = True, n_rows: int | None = None, categorical: list[str] | tuple[str, ...] = ()) -> dict:
    """Unfitted estimators by display name (fast: 5, full: 11).

    The fast boosters are ``GBTClassifier`` presets with the same iteration count, learning rate, depth and subsampling:
    one level of a tree is one Spark job either way, and MLlib's run in the JVM. The full catalogue has the library's own
    leaf-wise booster, ordered target statistics of the ``categorical`` columns, extra trees, AdaBoost and k-NN.
    """
    lr_reg = 1.0 / n_rows if n_rows else 0.0   # sklearn C=1 on the summed loss -> 1/(C*n) on the mean loss
    lr = LogisticRegression(maxIter=1000, regParam=lr_reg, elasticNetParam=0.0, standardization=False)
    if fast:
        return {
            "Régression logistique": lr,
            "Random Forest": RandomForestClassifier(numTrees=150, seed=SEED),
            "HistGradient Boosting": GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED),
            "XGBoost": GBTClassifier(maxIter=200, stepSize=0.1, maxDepth=5, subsamplingRate=0.9, seed=SEED),
            "LightGBM": GBTClassifier(maxIter=200, stepSize=0.05, maxDepth=5, seed=SEED),
        }
    return {
        "Régression logistique": lr,
        "Naive Bayes": NaiveBayes(modelType="gaussian"),
        "Random Forest": RandomForestClassifier(numTrees=300, seed=SEED),
        "Extra Trees": ExtraTrees(trees=300, seed=SEED),
        "AdaBoost": AdaBoostStumps(rounds=200),
        "k-NN": NearestNeighbours(k=15),
        "Gradient Boosting": GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED),
        "HistGradient Boosting": GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, seed=SEED),
        "XGBoost": GBTClassifier(maxIter=300, stepSize=0.1, maxDepth=5, subsamplingRate=0.9, seed=SEED),
        "LightGBM": LeafwiseBoosting(rounds=300, rate=0.05, leaves=31, depth=6, seed=SEED),
        "CatBoost": LeafwiseBoosting(rounds=300, rate=0.05, leaves=64, depth=6, categorical=tuple(categorical), seed=SEED),
    }


@dataclass
class Prepared:
    frame: DataFrame
    target: str
    numeric: list[str]
    categorical: list[str]
    stages: list = field(default_factory=list)


def prepare(df: DataFrame, target: str, ids: list[str], leaks: list[str], clip_outliers: bool = True,
            key: str | None = None) -> Prepared:
    """Clean (drop, impute, clip) -> derived features -> unfitted preprocessor.

    Rows with a NULL target are dropped (Q13); ``key`` is kept aside for splitting.
    """
    if target not in df.columns:
        raise ValueError(f"target column not found: {target}")
    base = df.where(F.col(target).isNotNull())
    keep_ids = [key] if key else []
    cleaned = clean(base, [i for i in ids if i not in keep_ids], leaks, target, clip_outliers)
    feats = add_features(cleaned)
    num, cat = split_columns(feats.drop(*keep_ids), target)
    feats = encode_target(feats, target)[0].withColumn("label", F.col("label").cast("double"))
    return Prepared(feats, target, num, cat, preprocessor(num, cat))


def _proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn(
        "pred", (F.col("p") >= 0.5).cast("int"))


def evaluate_predictions(pred: DataFrame, label: str = "label") -> dict:
    """Test metrics of one prediction frame (two aggregation jobs, one small row each)."""
    y = pred.withColumn("__y", F.col(label).cast("int"))
    out = E.confusion(y, "__y", "pred").first().asDict()
    out.update(E.roc_auc(y, "__y", "p").first().asDict())
    return out


@dataclass
class TrainResult:
    leaderboard: DataFrame
    best_name: str
    model: PipelineModel
    reason: str


def train_and_select(df: DataFrame, target: str, key: str, ids: list[str], leaks: list[str],
                     models: dict | None = None, folds: int = 3, test_pct: int = 20,
                     balance: str | None = "auto") -> TrainResult:
    """Per model CV on the train split, fit, test metrics; pick and refit the best.

    ``balance="auto"`` oversamples when the largest class is 1.5 times the smallest (C17), ``"smote"`` always, ``"weight"``
    uses class weights instead, None leaves the classes alone. Oversampling is done on the preprocessed vectors of each
    training set, never on evaluation rows (D14).
    """
    held: list[DataFrame] = []
    try:
        return _train_and_select(df, target, key, ids, leaks, models, folds, test_pct, balance, held)
    finally:
        for frame in held:
            frame.unpersist()


def _train_and_select(df: DataFrame, target: str, key: str, ids: list[str], leaks: list[str], models: dict | None, folds: int,
                      test_pct: int, balance: str | None, held: list[DataFrame]) -> TrainResult:
    spark = df.sparkSession
    if balance == "auto":   # C17: oversample when the classes are uneven enough
        balance = "smote" if imbalance(df.where(F.col(target).isNotNull()), target).first()["imbalanced"] else None
    prep = prepare(df, target, ids, leaks, key=key)
    split = E.stratified_split(prep.frame, "label", key, test_pct, SEED)
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    train = E.assign_folds(split.where(~F.col("is_test")).drop("class_rank", "class_n"), "label", key, folds, SEED)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    held += [split, train]
    test = split.where(F.col("is_test"))
    n_rows = train.count()
    if models is None or isinstance(models, (list, tuple)):
        # Names (or nothing): take them from the catalogue sized for this training set.
        full = {**catalogue(False, n_rows, prep.categorical), **catalogue(True, n_rows)}
        models = {n: full[n] for n in models} if models else catalogue(True, n_rows)
    rows = []
    # Fold fits and the train/test fit of one model are independent Spark jobs:
    # submit them from a few driver threads, bounded like the reference's
    # min(folds, cores / 2) workers.
    workers = max(1, min(folds + 1, spark.sparkContext.defaultParallelism // 2))
    from concurrent.futures import ThreadPoolExecutor

    def fit_eval(est, fit_df, eval_df):
        # Fresh copies per thread: estimators hold their JVM peer while fitting.
        return evaluate_predictions(_proba(fit_balanced([s.copy() for s in prep.stages], est.copy(), fit_df, balance, key), eval_df))

    mean = lambda v: sum(v) / len(v)
    std = lambda v: math.sqrt(sum((x - mean(v)) ** 2 for x in v) / len(v))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        for ordinal, (name, est) in enumerate(models.items()):
            jobs = [pool.submit(fit_eval, est, train.where(F.col("fold") != f), train.where(F.col("fold") == f))
                    for f in range(folds)]
            test_job = pool.submit(fit_eval, est, train, test)
            fold_metrics = [(r["auc"], r["f1"], r["accuracy"]) for r in (j.result() for j in jobs)]
            t = test_job.result()
            cv = list(zip(*fold_metrics))
            rows.append((ordinal, name, mean(cv[0]), std(cv[0]), mean(cv[1]), std(cv[1]), mean(cv[2]), std(cv[2]),
                         t["auc"], t["f1"], t["accuracy"], t["precision"], t["recall"]))
    board = spark.createDataFrame(rows, LEADERBOARD_SCHEMA)
    board = E.select_best(board, "test_roc_auc", "test_f1")
    best = board.where("selected").first()["model"]
    reason = E.selection_sentence(board, "model", "test_roc_auc", "test_f1").first()["reason"]
    final = fit_balanced(prep.stages, models[best], prep.frame, balance, key)
    return TrainResult(format_leaderboard(board), best, final, reason)


LEADERBOARD_SCHEMA = ("ordinal int, model string, cv_roc_auc double, cv_roc_auc_std double, cv_f1 double, "
                      "cv_f1_std double, cv_accuracy double, cv_accuracy_std double, test_roc_auc double, "
                      "test_f1 double, test_accuracy double, test_precision double, test_recall double")


def format_leaderboard(board: DataFrame) -> DataFrame:
    """4-decimal metrics, best first, selected flag."""
    metric_cols = [c for c in board.columns if c.startswith(("cv_", "test_"))]
    return board.select("position", "model", *[(F.rint(F.col(c) * 10000) / 10000).alias(c) for c in metric_cols],
                        "selected").orderBy("position")


def _with_weight(est, balance):
    if balance == "weight" and hasattr(est, "setWeightCol"):
        return est.copy().setWeightCol("class_weight")
    return est


def fit_balanced(stages: list, est, df: DataFrame, balance: str | None, key: str) -> PipelineModel:
    """Preprocessor, then oversampling of its vectors or class weights, then the model; one pipeline to score with."""
    before = Pipeline(stages=stages).fit(df)
    x = before.transform(df)
    if balance == "smote":
        from .neighbors import smote
        x = x.drop("class_rank", "class_n", "fold", "is_test").withColumn("features", vector_to_array("features"))
        x = smote(x, "label", key, ["features"]).withColumn("features", array_to_vector("features"))
    if balance == "weight":
        counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
        total, k = counts.agg(F.sum("__n"), F.count("*")).first()
        # One row per class: bounded broadcast.
        w = counts.select("label", (F.lit(float(total or 0)) / (F.lit(k) * F.col("__n"))).alias("class_weight"))
        x = x.join(F.broadcast(w), "label")
    x = cut_lineage(x)   # a fit reads its rows several times: neighbours are searched once
    if isinstance(est, GBTClassifier):
        x = x.coalesce(max(1, math.ceil(x.count() / BOOST_ROWS)))
    return PipelineModel(stages=[*before.stages, _with_weight(est, balance).fit(x)])


@dataclass
class StumpEnsemble:
    features: list[str]
    edges: dict                      # feature -> sorted inner bin edges
    stumps: list = field(default_factory=list)   # (feature, threshold_bin, polarity, alpha)


def _bin_col(c: str, edges: list[float]):
    arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    v = F.col(c).cast("double")
    return F.size(F.filter(arr, lambda e: e < v)).cast("int")


def adaboost(df: DataFrame, features: list[str], label: str = "label", rounds: int = 200, bins: int = 32,
             checkpoint_every: int = 10) -> StumpEnsemble:
    """SAMME AdaBoost of depth-1 trees on binned features (histogram stumps).

    One pass per round: every task adds the weighted positive/negative mass per
    ``(feature, bin)`` by arrays, Spark sums the tasks' cells - at most
    ``features x bins`` rows reach the driver, where the best threshold and
    polarity are picked; the weight update is a projection. Lineage is cut with a
    reliable checkpoint every ``checkpoint_every`` rounds.
    """
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs]), 10000)
                   .alias(f"e{i}") for i, c in enumerate(features)]).first()
    edges = {c: sorted(set(float(x) for x in (row[f"e{i}"] or []))) for i, c in enumerate(features)}
    y = F.col(label).cast("int")
    cur = df.select(*[_bin_col(c, edges[c]).alias(f"__b{i}") for i, c in enumerate(features)],
                    y.alias("__y"), F.lit(1.0).alias("__w")).where(F.col("__y").isNotNull())   # rows without a label have no mass
    cur = cut_lineage(cur)          # the binned frame: every round reads it, not the input plan
    model = StumpEnsemble(list(features), edges)
    shape = (len(features), max(map(len, edges.values()), default=0) + 1, 2)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(shape)
        for batch in batches:
            y, w = batch.column("__y").to_numpy(), batch.column("__w").to_numpy()
            for i in range(shape[0]):
                bins_of = batch.column(f"__b{i}").to_numpy()
                found[i, :, 0] += np.bincount(bins_of, w * y, shape[1])
                found[i, :, 1] += np.bincount(bins_of, w * (1 - y), shape[1])
        yield _cells(found)

    for r in range(rounds):
        hist = _summed(cur, masses, shape)
        best = None
        per = {f: dict(enumerate(map(tuple, hist[f]))) for f in range(shape[0])}
        total = sum(wp + wn for wp, wn in next(iter(per.values()), {}).values())   # every feature holds all rows once
        for f, d in per.items():
            nb = len(edges[features[f]]) + 1
            tot_p = sum(v[0] for v in d.values())
            tot_n = sum(v[1] for v in d.values())
            cp = cn = 0.0
            for t in range(nb):                      # predict 1 when bin > t (polarity +1)
                wp, wn = d.get(t, (0.0, 0.0))
                cp, cn = cp + wp, cn + wn
                err_pos = (cp + (tot_n - cn)) / total      # positives at or below t, negatives above
                err_neg = ((tot_p - cp) + cn) / total
                for err, pol in ((err_pos, 1), (err_neg, -1)):
                    if best is None or err < best[0] - 1e-15:
                        best = (err, f, t, pol)
        err, f, t, pol = best
        if err >= 0.5:
            break
        err = max(err, 1e-10)
        alpha = math.log((1 - err) / err)
        model.stumps.append((f, t, pol, alpha))
        pred = _stump_pred(F.col(f"__b{f}"), t, pol)
        cur = cur.withColumn("__w", F.col("__w") * F.exp(F.lit(alpha) * (pred != F.col("__y")).cast("double")))
        if (r + 1) % checkpoint_every == 0:
            cur = cut_lineage(cur)
        if err <= 1e-10:
            break
    return model


def _stump_pred(b, t: int, pol: int):
    return F.when(b > t, F.lit(1 if pol == 1 else 0)).otherwise(F.lit(0 if pol == 1 else 1))


def adaboost_scores(df: DataFrame, model: StumpEnsemble) -> DataFrame:
    """P(class 1) = sigmoid(2 * sum(alpha * (2*pred - 1)) / sum(alpha)), one column expression."""
    bins = {c: _bin_col(c, model.edges[c]) for c in model.features}
    total = sum(a for *_, a in model.stumps) or 1.0
    f = F.lit(0.0)
    for fi, t, pol, alpha in model.stumps:
        f = f + F.lit(alpha) * (2 * _stump_pred(bins[model.features[fi]], t, pol) - 1)
    return df.withColumn("p", 1 / (1 + F.exp(-2 * f / total)))


def log_runs(spark, root: str, leaderboard: DataFrame, dataset: str, params: dict | None = None) -> None:
    """Append the leaderboard of one training run to the ``runs`` table."""
    import datetime as _dt
    import json as _json
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    (leaderboard.withColumn("run_ts", F.lit(now)).withColumn("dataset", F.lit(dataset))
     .withColumn("params", F.lit(_json.dumps(params or {}, sort_keys=True)))
     .write.mode("append").parquet(f"{root.rstrip('/')}/runs"))
