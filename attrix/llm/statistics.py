"""Statistics of whole texts: one pass over a document, a row of numbers for it.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. All
counts are 0 for a null or empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import Rolling, covered, distinct, words_of

COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower",
          "n_digits", "n_exclaim", "n_stops", "n_commas", "n_pipes", "n_repeat_next", "longest_word")
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS``; letters and digits are those of ASCII."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    hashes, starts, ends = words_of(data)
    n = len(hashes)
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            again += line in seen
            seen.add(line)
    kinds = repeats = following = longest = 0
    if n:
        kinds = len(distinct(hashes))
        following = int((hashes[1:] == hashes[:-1]).sum())
        longest = int((ends - starts).max())
        grams = Rolling(hashes).windows(3)
        if len(grams) > 1:
            order = np.argsort(grams)
            same = grams[order][1:] == grams[order][:-1]
            if same.any():
                twice = np.zeros(len(grams), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                repeats = int(covered(np.flatnonzero(twice), 3, n).sum())
    count = text.count
    size = len(data)
    return (len(text), n, len(text) - sum(map(count, _SPACE)), sum(map(count, SYMBOLS)), lines, again, repeats, kinds,
            size - len(data.translate(None, _UPPER)), size - len(data.translate(None, _LOWER)), size - len(data.translate(None, _DIGIT)),
            count("!"), count("."), count(","), count("|"), following, longest)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*map(text_counts, batch.column("text").to_pylist()))) or [()] * len(COUNTS)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(c, pa.int64()) for c in columns)], [*others, *COUNTS])


def with_counts(docs: DataFrame) -> DataFrame:
    """``COUNTS`` of the column text, which they replace; a row per input row."""
    others = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(_counts, ", ".join(others + [f"{c} long" for c in COUNTS]))


#: Ratios of the counts that do not depend on the length of a text.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"), "distinct_rate": ("n_distinct_words", "n_words"), "upper_rate": ("n_upper", "n_chars"),
    "lower_rate": ("n_lower", "n_chars"), "digit_rate": ("n_digits", "n_chars"), "exclaim_rate": ("n_exclaim", "n_words"),
    "stop_rate": ("n_stops", "n_words"), "comma_rate": ("n_commas", "n_words"), "pipe_rate": ("n_pipes", "n_words"),
    "next_rate": ("n_repeat_next", "n_words"), "line_words": ("n_words", "n_lines"),
}


def with_ratios(counts: DataFrame) -> DataFrame:
    """Adds the ``RATIOS`` as doubles; 0 where there is nothing to divide by."""
    return counts.select("*", *[F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).alias(n) for n, (a, b) in RATIOS.items()])
