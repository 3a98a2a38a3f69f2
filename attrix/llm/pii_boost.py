"""Personal data: candidate spans, gradient-boosted trees, calibrated thresholds.

1. *Base*: the four patterns (e-mail, ip, card, phone) with their checks. A base span is always redacted.
2. *Generators* propose further, overlapping spans with high recall: obfuscated addresses, dotted numbers with spaces,
   long digit groups, telephone numbers without a plus sign.
3. *Boosted trees* judge candidates by their format (digits, groups, separators) and context (words and characters
   around). They learn from a bounded sample of distinct candidates (copies of one with its context count once): spans that
   pass the base checks are personal data, spans that fail the check of their kind, or lie in a checked span of another
   kind, are none. What the checks themselves look at (plus sign, check digit, range of parts) is no feature.
4. *Calibration*: on all such candidates of the corpus outside the sample, copies included, each kind gets the least
   threshold whose precision reaches ``PRECISION``; without such a threshold the kind gets no additional spans. Only a
   histogram of (kind, score bin, label) leaves the tasks. Accepted candidates that touch no base span and no better
   candidate are added.

Spans are code point offsets, end exclusive. The fitted trees are plain data of bounded size that goes to the tasks;
texts are read three times (sample, calibration, redaction) and never shuffled.

Edge cases: a null text is empty and has no spans; matches that fail their check are dropped without another try; a null
id is handled like any other; repeated rows get a result each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import documents, row_schema, stored
from attrix.llm.trees import evaluate, tree_paths

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 20_000
PRECISION = 0.98
ROUNDS, DEPTH = 15, 3
#: Score bins of the calibration; thresholds are their lower edges, exact as the number is a power of 2.
BINS = 1 << 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where a run of digits begins, as its start is greedy; the look-behind only saves retries.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,12}(?![A-Za-z0-9])"
                          r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} at [A-Za-z0-9-]{2,64} dot [A-Za-z]{2,12}(?![A-Za-z0-9])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ .()-]{0,2}[0-9]){6,23}(?![0-9A-Za-z])")
_WORD_BEFORE = re.compile(r"(\S+)\s*\Z")
_HINTS = (("mail", "contact", "courriel", "correo"), ("ip", "host", "server", "address", "adresse"), ("card", "visa", "carte", "karte", "tarjeta", "credit"), ("tel", "phone", "call", "fax", "mobile", "appel", "ruf", "llama"))

FORMAT = ["kind", "length", "digits", "letters", "separators", "groups", "longest_group", "shortest_group", "dots", "dashes", "spaces", "parens"]
CONTEXT = ["glued_before", "glued_after", "hint_email", "hint_ip", "hint_card", "hint_phone", "label_before", "line_start", "line_end", "digits_near"]
FEATURES = FORMAT + CONTEXT


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """E-mail spans: for every at sign the longest local part before it and a dotted domain after it."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def checked(kind: int, match: str) -> bool:
    """The check of a kind on a string of its pattern."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    digits = _NOT_DIGIT.sub("", match)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """Spans per kind that match and pass; and (kind, start, end) of those that match and fail."""
    good: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    failed = []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text) if kind != 3 or "+" in text else ():
            if checked(kind, m[0]):
                good[kind].append(m.span())
            elif kind != 2 or m.end() - m.start() >= 9:
                failed.append((kind, *m.span()))
    return good, failed


def candidates(text: str, good: list[list[tuple[int, int]]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further (kind, start, end), overlaps included, without the base spans themselves."""
    found = set(failed)
    if " dot " in text or "(at)" in text or "[at]" in text:
        found.update((0, *m.span()) for m in _LOOSE_EMAIL.finditer(text))
    for m in _LOOSE_NUMBER.finditer(text):
        digits = sum(map(str.isdigit, m[0]))
        if digits >= 12:
            found.add((2, *m.span()))
        if digits <= 15:
            found.add((3, *m.span()))
    return sorted(found - {(k, *s) for k, spans in enumerate(good) for s in spans})


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end].lstrip("+")
    groups = [len(g) for g in _NOT_DIGIT.split(span) if g] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    word = _WORD_BEFORE.search(before)
    hint = word[1].lower() if word else ""
    return [float(x) for x in (
        kind, len(span), sum(groups), sum(map(str.isalpha, span)), sum(not c.isalnum() for c in span), len(groups), max(groups), min(groups),
        span.count("."), span.count("-"), span.count(" "), span.count("("),
        before[-1:].isalnum(), after[:1].isalnum(), *(any(h in hint for h in hs) for hs in _HINTS), hint.endswith((":", "=")),
        not before or before[-1] == "\n", not after or after[0] == "\n", any(c.isdigit() for c in before[-12:] + after[:12]))]


def _touches(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    return any(span[0] < e and s < span[1] for s, e in others)


def labelled(text: str) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, weak label): passed its check, failed it, or inside a checked span of another kind."""
    good, failed = base_spans(text)
    every = [(k, s, e, 1.0) for k, spans in enumerate(good) for s, e in spans] + [(k, s, e, 0.0) for k, s, e in failed]
    return every + [(k, s, e, 0.0) for k, s, e in candidates(text, good, ()) if _touches((s, e), [x for j, spans in enumerate(good) if j != k for x in spans])]


def key_of(text: str, kind: int, start: int, end: int, label: float) -> int:
    """Hash of all that the features and the label are made of; equal for copies, wherever they stand."""
    seen = "\0".join((f"{kind}:{label:.0f}", text[max(0, start - 40) : start], text[start:end], text[end : end + 20]))
    return int.from_bytes(hashlib.blake2b(seen.encode(), digest_size=8).digest(), "little", signed=True)


def _sample(rows: int):
    """The distinct candidates of the least even keys, as many as the whole sample has at most, of every task."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[float]] = {}
        bound = 1 << 63
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for k, s, e, y in labelled(text) if text else ():
                    key = key_of(text, k, s, e, y)
                    if key % 2 == 0 and key < bound and key not in kept:
                        kept[key] = [y, *features(text, k, s, e)]
                        if len(kept) >= 2 * rows:
                            kept = {i: kept[i] for i in sorted(kept)[:rows]}
                            bound = max(kept)
        columns = list(zip(*kept.values())) or [()] * (1 + len(FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], ["key", "label", *FEATURES])
    return sample


def _histogram(trees: list, weights: list[float], last: int | None):
    """Counts of (kind, score bin, label) of the candidates outside the sample: those of odd keys or beyond the last key."""
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, int, int]] = Counter()
        for batch in batches:
            rows, kinds, labels = [], [], []
            for text in batch.column("text").to_pylist():
                for k, s, e, y in labelled(text) if text else ():
                    key = key_of(text, k, s, e, y)
                    if key % 2 or (last is not None and key > last):
                        rows.append(features(text, k, s, e))
                        kinds.append(k)
                        labels.append(int(y))
            if rows:
                counts.update(zip(kinds, (probability(trees, weights, np.array(rows)) * BINS).astype(int).tolist(), labels))
        a = list(zip(*((*c, n) for c, n in counts.items()))) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in a], ["kind", "bin", "label", "n"])
    return histogram


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> tuple[list, list[float], list[float]]:
    """Trees, their weights, and the threshold per kind (2 where no candidate is to be added)."""
    schema = "key long, label double, " + ", ".join(f"{c} double" for c in FEATURES)
    train = stored(docs.mapInArrow(_sample(rows), schema).dropDuplicates(["key"]).orderBy("key").limit(rows).coalesce(2), "candidates")
    if train.select("label").distinct().count() < 2:
        return [], [], [2.0] * len(KINDS)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
    model = GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(assembled)
    trees, weights = tree_paths(model), [float(w) for w in model.treeWeights]
    size = train.agg(F.count("*").alias("n"), F.max("key").alias("last")).first()
    counted = docs.mapInArrow(_histogram(trees, weights, size["last"] if size["n"] == rows else None), "kind long, bin long, label long, n long")
    held = counted.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()  # a row per kind and bin at most
    thresholds = [2.0] * len(KINDS)
    for k in range(len(KINDS)):
        n = good = 0
        for row in sorted((r for r in held if r["kind"] == k), key=lambda r: -r["bin"]):
            n, good = n + row["n"], good + row["good"]
            if good / n >= precision:
                thresholds[k] = max(0.5, row["bin"] / BINS)
    return trees, weights, thresholds


def probability(trees: list, weights: list[float], x: np.ndarray) -> np.ndarray:
    """Logistic link of the boosted margin."""
    return 1 / (1 + np.exp(-2 * evaluate(trees, weights, x)))


def all_spans(text: str, trees: list, weights: list[float], thresholds: list[float]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """Base spans per kind, and all spans (kind, start, end) by kind and start."""
    good, failed = base_spans(text)
    every = [(k, s, e) for k, spans in enumerate(good) for s, e in spans]
    more = candidates(text, good, failed) if trees else []
    if more:
        score = probability(trees, weights, np.array([features(text, *c) for c in more]))
        taken = [(s, e) for _, s, e in every]
        for i in sorted(range(len(more)), key=lambda i: (-score[i], more[i])):
            kind, s, e = more[i]
            if score[i] >= thresholds[kind] and not _touches((s, e), taken):
                taken.append((s, e))
                every.append(more[i])
    return good, sorted(every)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones together) replaced by the name of its first kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _apply(trees: list, weights: list[float], thresholds: list[float], with_text: bool):
    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                good, every = all_spans(text or "", trees, weights, thresholds)
                base = written([(k, s, e) for k, spans in enumerate(good) for s, e in spans])
                rows.append((*map(len, good), hashlib.sha256(base.encode()).hexdigest(), written(every), *([redacted(text, every) if text else text] if with_text else [])))
            a = list(zip(*rows)) or [()] * (6 + with_text)
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *(["redacted", "row"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in a[:4]), *(pa.array(x, pa.string()) for x in a[4:]),
                                              *([batch.column("row")] if with_text else [])], names)
    return apply


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted, row]): one row per input row."""
    whole = documents(docs, id_col, text_col, with_text)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", redacted string" + row_schema(whole) if with_text else "")
    return whole.mapInArrow(_apply(*fit(whole.select("text")), with_text), schema)
