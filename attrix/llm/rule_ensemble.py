"""Quality classifier as a sparse ensemble of rules.

Shallow trees are grown on the statistics of labelled documents; every path from a root is a conjunctive rule. A
logistic regression with a lasso penalty weighs the rules and sets most weights to zero. What is left is compiled into
one Spark column expression over the statistics, so scoring needs no model object: one pass over the texts.

At most ``LABELLED_ROWS`` labelled rows (the first in hash order, any language or source) train the model; scores cover
all documents. Only statistics of the text are inputs.

Edge cases: null and empty texts have zero statistics and a score like any other; null labels do not train; with labels of
one kind only or none at all, the score is the (smoothed) share of good labels; null ids and repeated rows get a
score per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import documents, stored
from attrix.llm.statistics import RATIOS, with_counts, with_ratios
from attrix.llm.trees import Condition, tree_paths

LABELLED_ROWS = 20_000
TREES, DEPTH, LASSO = 20, 3, 0.002
INPUTS = ["n_words", "n_lines", "longest_word", *RATIOS]


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row is kept from training: crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, label): a bounded sample of labelled rows for training, in hash order of their ids."""
    known = labels.where(train & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    return known.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def rule_column(rule: tuple[Condition, ...], names: list[str]) -> Column:
    parts = [(F.col(names[i]) <= t) if at_most else (F.col(names[i]) > t) for i, at_most, t in rule]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p
    return whole


def fit_rules(sample: DataFrame, names: list[str] = INPUTS) -> tuple[float, list[tuple[tuple[Condition, ...], float]]]:
    """Intercept and the weighted rules with weights other than zero."""
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        good, n = kinds.get(1.0, 0), sum(kinds.values())
        return log((good + 1) / (n - good + 1)), []
    sample = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64, subsamplingRate=0.7).fit(sample)
    rules = sorted({path[:k] for leaves in tree_paths(forest) for path, _ in leaves for k in range(1, len(path) + 1)})
    if not rules:
        return log((kinds[1.0] + 1) / (kinds[0.0] + 1)), []
    flags = sample.select("label", *[rule_column(r, names).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(flags).select("label", "rules").persist()
    try:
        lasso = LogisticRegression(featuresCol="rules", labelCol="label", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=50).fit(flags)
    finally:
        flags.unpersist()
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[tuple[tuple[Condition, ...], float]], names: list[str] = INPUTS) -> Column:
    """The ensemble as one column expression."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(rule_column(rule, names), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fitted_score(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", rows: int = LABELLED_ROWS) -> Column:
    """The score of (doc_id, text) rows as a column over their statistics."""
    known = stored(labelled(labels, label, F.lit(True) if train is None else train, rows), "labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``rows`` labels
    # Stored first: coalesced above the join, its two tasks would read all texts.
    return score_column(*fit_rules(stored(with_ratios(with_counts(sample)), "sample").coalesce(2)))


def rule_ensemble(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                  label: str = "quality", rows: int = LABELLED_ROWS, keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted[, row]): one row per input row. ``train`` is a condition on the labels' doc_id."""
    score = fitted_score(documents(docs, id_col, text_col), labels, train, label, rows)
    counted = with_ratios(with_counts(documents(docs, id_col, text_col, keep)))
    return counted.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *(["row"] if keep else []))
