"""Quality rules under weak supervision.

Every rule votes good, bad or abstains. Expectation-maximisation estimates, without labels, how often each rule votes
what on good and on bad documents; the posterior probability of a document, given all its votes, decides in place of
"all rules must pass". The rules are taken as independent given the quality.

The votes of a document are one of at most 3 ** rules patterns, so the estimate runs on the histogram of all documents'
patterns, which is bounded whatever the size of the corpus; the posterior of each pattern goes back by a broadcast of
that table.

Edge cases: a null or empty text has no words, and fails the base rule; a null id is judged like any other; repeated
rows get one result each; with an empty table the prior stands and the result is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import documents, stored
from attrix.llm.statistics import with_counts, with_ratios

#: name: (bad if, good if); otherwise the rule abstains.
RULES = {
    "upper": ("n_upper > n_lower", "n_upper < 0.3 * n_lower"),
    "exclaim": ("exclaim_rate > 0.2", "exclaim_rate < 0.05"),
    "symbols": ("symbol_rate > 0.2", "symbol_rate < 0.05"),
    "symbol_share": ("n_symbols > 0.05 * word_chars", "n_symbols < 0.01 * word_chars"),
    "letters": ("n_upper + n_lower < 0.7 * word_chars", "n_upper + n_lower > 0.8 * word_chars"),
    "repeats": ("repeat_rate > 0.3", "repeat_rate < 0.1"),
    "next_word": ("next_rate > 0.2", "next_rate < 0.03"),
    "lines": ("dup_line_rate > 0.3", "n_lines > 1 and n_dup_lines = 0"),
    "word_length": ("word_length < 2.5 or word_length > 14", "word_length between 3.5 and 10"),
    "sentences": ("stop_rate = 0 and n_words >= 30", "stop_rate between 0.01 and 0.3"),
    "length": ("n_words < 20", "n_words >= 50"),
}
START_ACCURACY, START_PRIOR = 0.8, 0.9
TOLERANCE = 1e-7


def vote_columns() -> list[Column]:
    """A column per rule: 1 good, 0 bad, 2 abstained."""
    return [F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(2).cast("int").alias(f"vote_{name}") for name, (bad, good) in RULES.items()]


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, votes' probabilities [rule, quality, vote], posterior of good per pattern) by EM."""
    rules = votes.shape[1]
    prior = START_PRIOR
    chance = np.empty((rules, 2, 3))
    for quality in (0, 1):
        chance[:, quality, quality] = START_ACCURACY * 0.8
        chance[:, quality, 1 - quality] = (1 - START_ACCURACY) * 0.8
        chance[:, quality, 2] = 0.2
    before = -np.inf
    while True:
        log = np.log(chance[np.arange(rules)[None, :], :, votes]).sum(axis=1) + np.log([1 - prior, prior])
        top = log.max(axis=1, keepdims=True)
        weight = np.exp(log - top)
        total = weight.sum(axis=1, keepdims=True)
        posterior = weight / total
        likelihood = float((counts * (np.log(total) + top)[:, 0]).sum() / max(counts.sum(), 1))
        if likelihood - before < TOLERANCE:
            return prior, chance, posterior[:, 1]
        before = likelihood
        mass = posterior * counts[:, None]
        prior = float(np.clip((mass[:, 1].sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        for v in range(3):
            chance[:, :, v] = np.stack([(mass * (votes[:, r] == v)[:, None]).sum(axis=0) for r in range(rules)]) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality, votes)."""
    table = stored(with_ratios(with_counts(documents(docs, id_col, text_col))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.concat(*vote_columns()).alias("votes")), "votes")
    patterns = table.groupBy("votes").count().collect()  # at most 3 ** rules rows
    names = [r["votes"] for r in patterns]
    votes = np.array([[int(c) for c in v] for v in names], int).reshape(len(names), len(RULES))
    posterior = estimate(votes, np.array([r["count"] for r in patterns], float))[2] if names else []
    known = docs.sparkSession.createDataFrame([(v, float(p)) for v, p in zip(names, posterior)], "votes string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (table.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", "votes"))
