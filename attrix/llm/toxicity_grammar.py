"""Toxicity as a weighted finite-state pattern grammar over clauses.

Words become classes: insult and threat stems, targets (persons spoken to or about), negations, verbs and marks of
reported speech, clause ends, and all other words. Small transducers each read a clause of classes:

* *insult* and *threat* emit a mark at every word of their class,
* *target* remembers whether a person was named near the mark,
* *negation* and *reported speech* remember that the mark stands in their scope.

Their composition is one deterministic machine, built once as a table (state x class -> state, output); an output names
the kind of match, e.g. a targeted insult or a negated, reported threat. A text is scored by the marks of its matched
clauses, weighted per kind, not by isolated words: clauses without a mark are not read at all.

Stems and weights come from labelled rows (at most ``LABELLED_ROWS``): a stem is a word beginning (or a whole word) that
toxic documents have far more often than others, its weight the smoothed log ratio; the weights of the kinds
are a logistic regression on the sums of matches. Function words of the scopes are fixed lists.

Edge cases: null and empty texts have no clause and the score of a text without matches; null labels do not train;
without labels of both kinds there are no stems and the score is the (smoothed) share of toxic labels, 0.5 with no label
at all; null ids and repeated rows get a score per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import documents, stored
from attrix.llm.rule_ensemble import LABELLED_ROWS, labelled

# Function words of the scopes, in English, French, German and Spanish.
TARGETS = "you your yours yourself he she they him them his her their tu te toi vous votre vos ton ta du dich dir dein deine ihr euch sie usted ustedes ti tus vosotros él ella ellos"
NEGATIONS = "not no never neither nor none without ne pas jamais aucun sans nicht kein keine nie ohne nunca ningún ninguna sin"
REPORTS = "said says say called told wrote quoted claimed reported dit disait écrit appelé sagte sagt schrieb nannte dijo dice llamó escribió"
#: Words of a threat in general use; stems learned from labels are insults.
THREATS = "kill hurt destroy beat murder attack tuer frapper détruire töten schlagen zerstören matar golpear destruir"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
#: Words that a target, a negation or reported speech reaches forward.
REACH = {TARGET: 6, NEGATION: 3, REPORT: 12}
#: Beginnings of words that may be stems; "$" closes a whole word.
STEM_LENGTHS = (4, 5, 6, 7)
#: Least log-likelihood ratio statistic and least ratio of the document shares of a stem, and how many stems are kept.
STEM_LEVEL, STEM_RATIO, STEM_COUNT = 20.0, 8.0, 5_000

_PLAIN = re.compile(r"^[^\w]+|[^\w]+$")
_END = (".", ",", ";", ":", "!", "?", '."', '!"', '?"')


def plain(word: str) -> str:
    return _PLAIN.sub("", word).lower()


# ---- transducers ------------------------------------------------------------------------------------------------

def scope_transducer(opens: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(state, class) -> (state, output): words left in the scope that a class opens; the output tells if it is open."""
    reach = REACH[opens]
    table = {}
    for state in range(reach + 1):
        for c in range(7):
            after = 0 if c == BREAK else reach if c == opens else max(state - 1, 0)
            table[state, c] = after, int(state > 0)
    return table


def mark_transducer() -> dict[tuple[int, int], tuple[int, int]]:
    """Emits 1 at an insult and 2 at a threat."""
    return {(0, c): (0, 1 if c == INSULT else 2 if c == THREAT else 0) for c in range(7)}


def composed(machines: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """Product of the machines, reachable states only: next[state][class], outputs[state][class]."""
    start = (0,) * len(machines)
    number, todo = {start: 0}, [start]
    following: list[list[int]] = []
    outputs: list[list[tuple[int, ...]]] = []
    for state in todo:
        row, out = [], []
        for c in range(7):
            steps = [m[s, c] for m, s in zip(machines, state)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            out.append(tuple(o for _, o in steps))
        following.append(row)
        outputs.append(out)
    return following, outputs


NEXT, OUT = composed([mark_transducer(), scope_transducer(TARGET), scope_transducer(NEGATION), scope_transducer(REPORT)])
#: Kinds of matches: mark (insult, threat) x targeted x negated x reported.
KINDS = 16


def kind_of(output: tuple[int, ...]) -> int:
    mark, target, negated, reported = output
    return (mark - 1) * 8 + target * 4 + negated * 2 + reported


class Classes(dict):
    """Class and stem weight of a raw word, remembered; emptied at a fixed size."""

    LIMIT = 500_000

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws.split()}

    def weight(self, word: str) -> float:
        return max([self.stems.get(word + "$", 0.0), *(self.stems.get(word[:k], 0.0) for k in STEM_LENGTHS if len(word) >= k)])

    def __missing__(self, raw: str) -> tuple[int, float] | None:
        if len(self) >= self.LIMIT:
            self.clear()
        word = plain(raw)
        weight = self.weight(word)
        value = (INSULT, weight) if weight > 0 else (self.fixed[word], 1.0) if word in self.fixed else None
        self[raw] = value
        return value


def matches(text: str | None, classes: Classes) -> np.ndarray:
    """Sum of mark weights per kind of match, and the strongest clause."""
    total, strongest = np.zeros(KINDS), 0.0
    words = text.split() if text else []
    found = list(map(classes.__getitem__, words))
    marks = [i for i, c in enumerate(found) if c is not None and c[0] in (INSULT, THREAT)]
    done = -1
    for i in marks:
        if i <= done:
            continue
        # The clause around the mark, at most the longest reach before it.
        start = i
        while start > 0 and i - start <= max(REACH.values()) and not words[start - 1].endswith(_END):
            start -= 1
        state, clause, k = 0, 0.0, max(start, done + 1)
        while k < len(words):
            c, weight = found[k] or (OTHER, 0.0)
            if c in (INSULT, THREAT):
                total[kind_of(OUT[state][c])] += weight
                clause += weight
            state = NEXT[state][c]
            if words[k].endswith(_END):
                break
            k += 1
        done = k
        strongest = max(strongest, clause)
    return np.append(total, strongest)


FEATURES = [f"k{i}" for i in range(KINDS)] + ["strongest"]


def _score(stems: dict[str, float]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(stems)
        for batch in batches:
            rows = [matches(t, classes) for t in batch.column("text").to_pylist()]
            x = np.log1p(np.stack(rows)) if rows else np.zeros((0, KINDS + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, j]) for j in range(KINDS + 1))], ["doc_id", *FEATURES])
    return score


def match_table(docs: DataFrame, stems: dict[str, float]) -> DataFrame:
    """doc_id and the logarithms of the match sums, a row per input row."""
    return docs.mapInArrow(_score(stems), "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES))


# ---- learning ---------------------------------------------------------------------------------------------------

def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word beginning, by label, summed up in the task."""
    counts = {0.0: Counter(), 1.0: Counter()}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = {plain(w) for w in set((text or "").split())}
            counts[label].update({w + "$" for w in words if w} | {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k})
    stems = sorted(counts[0.0].keys() | counts[1.0].keys())
    yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([counts[y][s] for s in stems], pa.int64()) for y in (1.0, 0.0))], ["stem", "toxic", "clean"])


def learned_stems(sample: DataFrame) -> dict[str, float]:
    """Beginnings far more frequent in toxic documents, with the logarithm of that ratio; at most ``STEM_COUNT``."""
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return {}
    toxic, clean = kinds[1.0], kinds[0.0]
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))

    def part(seen: Column, of: int) -> Column:  # of the statistic, for the documents with the stem
        return F.when(seen > 0, seen * F.log(seen * (toxic + clean) / ((F.col("toxic") + F.col("clean")) * of))).otherwise(F.lit(0.0))

    level = 2 * (part(F.col("toxic"), toxic) + part(F.col("clean"), clean))
    rows = (sample.mapInArrow(_beginnings, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .withColumn("ratio", ratio).where((F.col("ratio") >= STEM_RATIO) & (level >= STEM_LEVEL))
            .orderBy(F.desc("toxic"), "stem").limit(STEM_COUNT).collect())
    stems: dict[str, float] = {}
    # Shorter beginnings first: a longer one, or the whole word, adds nothing to a stem that it begins with.
    for r in sorted(rows, key=lambda r: (r["stem"].endswith("$"), len(r["stem"]), r["stem"])):
        word = r["stem"].rstrip("$")
        if not any(word[:k] in stems for k in STEM_LENGTHS if len(word) >= k):
            stems[r["stem"]] = float(np.log(r["ratio"]))
    return stems


def toxicity_grammar(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                     label: str = "toxic", rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, score, predicted): one row per input row. ``train`` is a condition on the labels' doc_id."""
    docs = documents(docs, id_col, text_col)
    known = stored(labelled(labels, label, F.lit(True) if train is None else train, rows), "labels")
    sample = stored(docs.join(F.broadcast(known), "doc_id"), "sample")  # at most ``rows`` labels
    stems = learned_stems(sample)
    table = stored(match_table(docs, stems), "matches")
    share = sample.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
    prior = ((share["p"] or 0.0) * share["n"] + 1) / (share["n"] + 2)
    if not stems:
        return table.select("doc_id", F.lit(prior).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    # Stored first: coalesced above the join, its two tasks would read the matches of all documents.
    fit = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(stored(table.join(F.broadcast(known), "doc_id"), "fit").coalesce(2))
    model = LogisticRegression(labelCol="label", regParam=0.001, standardization=False, maxIter=100).fit(fit)
    total = F.lit(float(model.intercept))
    for name, weight in zip(FEATURES, model.coefficients.toArray().tolist()):
        total = total + F.lit(weight) * F.col(name)
    return table.select("doc_id", (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
