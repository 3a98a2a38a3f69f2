"""Splits, folds and evaluation metrics.

Stratified split / folds without a per-class global sort
---------------------------------------------------------
Rows are ordered inside their class by ``md5(key || '-' || seed)``. The exact
per-class rank is assembled from two parts:

* the first 16 bits of the hash give one of 65 536 buckets; the per
  ``(class, bucket)`` counts form a table of at most ``classes x 65 536`` rows
  whose running sums (a window over that small table) are broadcast back - the
  broadcast size is fixed by construction, not by the data;
* inside each ``(class, bucket)`` a ``row_number`` orders the few rows that
  share the bucket.

So a class holding a third of all rows is spread over 65 536 window partitions
instead of one task sorting it, and the result equals
``row_number() OVER (PARTITION BY class ORDER BY md5(...))``.

Exact ROC-AUC without a global sort
-----------------------------------
AUC = sum over positives of (negatives scored lower + half the ties) / (P * N).
Scores are first aggregated per distinct value (map-side combined), prefix sums
of negatives are built per score bucket and inside buckets, as above. Equals
``BinaryClassificationEvaluator(numBins=0)`` and the rank-sum formula with
averaged ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 65536
SCORE_BUCKETS = 256


def hash_order(key, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def class_rank(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``class_rank`` (1-based rank inside the class by hash order) and ``class_n``."""
    h = hash_order(key, seed)
    x = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = x.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label).orderBy("__b")
    offsets = counts.select(
        label, "__b",
        (F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(label)).alias("class_n"))
    # <= classes x 65 536 rows: bounded by construction, safe to broadcast.
    x = x.join(F.broadcast(offsets), [label, "__b"])
    rn = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h"))
    return x.withColumn("class_rank", F.col("__before") + rn).drop("__h", "__b", "__before")


def stratified_split(df: DataFrame, label: str, key: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """``is_test`` for the first ceil(n_class * test_pct / 100) rows of each class."""
    r = class_rank(df, label, key, seed)
    n_test = F.floor((F.col("class_n") * test_pct + 99) / 100)
    return r.withColumn("is_test", F.col("class_rank") <= n_test)


def assign_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``fold = (rank - 1) % k`` inside each class (stratified, shuffled by hash)."""
    r = class_rank(df, label, key, seed)
    return r.withColumn("fold", ((F.col("class_rank") - 1) % k).cast("int"))


def confusion(df: DataFrame, label: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """TP/FP/FN/TN and accuracy, precision, recall, F1 (zero division -> 0)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    g = df.groupBy(*(group or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                    F.lit(0.0))
    acc = F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"),
                                  F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), F.lit(0.0))
    return g.withColumns({"accuracy": acc, "precision": prec, "recall": rec, "f1": f1})


def roc_auc(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC with averaged ties, per ``group`` (see module docstring)."""
    group = list(group or [])
    per_value = df.groupBy(*group, F.col(score).alias("__s")).agg(
        F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) != 1).alias("__neg"))
    # Bucket edges follow the scores, wherever they crowd; any edges give the same area.
    edges = per_value.agg(F.percentile_approx("__s", [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)], 10_000)).first()[0] or []
    known = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    per_value = per_value.withColumn("__b", F.size(F.filter(known, lambda e: e < F.col("__s"))))
    buckets = per_value.groupBy(*group, "__b").agg(F.sum("__neg").alias("__bn"))
    wb = Window.partitionBy(*group).orderBy("__b") if group else Window.orderBy("__b")
    buckets = buckets.select(*group, "__b", (F.sum("__bn").over(wb.rowsBetween(Window.unboundedPreceding, 0))
                                             - F.col("__bn")).alias("__neg_before_bucket"))
    x = per_value.join(buckets, group + ["__b"])
    wi = Window.partitionBy(*group, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__neg_below", F.col("__neg_before_bucket") + F.coalesce(F.sum("__neg").over(wi), F.lit(0)))
    agg = x.groupBy(*group).agg(
        F.sum(F.col("__pos") * (F.col("__neg_below") + 0.5 * F.col("__neg"))).alias("__u"),
        F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"))
    return agg.select(*group, "n_pos", "n_neg",
                      F.try_divide(F.col("__u"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def cv_summary(per_fold: DataFrame, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """D3: mean and population std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*(group or [])).agg(*aggs)


def select_best(results: DataFrame, auc: str = "auc", f1: str = "f1", order: str = "ordinal") -> DataFrame:
    """Leaderboard sorted by (AUC desc, F1 desc); first listed wins ties; selected flag."""
    w = Window.orderBy(F.col(auc).desc_nulls_last(), F.col(f1).desc_nulls_last(), F.col(order))
    return results.withColumn("position", F.row_number().over(w)).withColumn("selected", F.col("position") == 1)


def selection_sentence(board: DataFrame, name: str = "model", auc: str = "auc", f1: str = "f1") -> DataFrame:
    """Explanation of the choice with the runner-up (leaderboard rows only)."""
    pick = lambda pos, c: F.max(F.when(F.col("position") == pos, F.col(c)))
    j = board.agg(pick(1, name).alias("best"), pick(1, auc).alias("best_auc"), pick(1, f1).alias("best_f1"),
                  pick(2, name).alias("second"), pick(2, auc).alias("second_auc"))
    return j.select(F.when(F.col("second").isNull(),
                           F.format_string("%s est le seul modele evalue (ROC-AUC %.4f, F1 %.4f).",
                                           "best", "best_auc", "best_f1"))
                    .otherwise(F.format_string("%s a la meilleure ROC-AUC sur le jeu de test (%.4f, F1 %.4f), devant %s (%.4f).",
                                               "best", "best_auc", "best_f1", "second", "second_auc"))
                    .alias("reason"))
