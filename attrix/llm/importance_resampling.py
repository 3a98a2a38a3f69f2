"""Importance resampling toward a target distribution, by hashed n-gram counts.

A table of 256 bytes lower-cases A-Z and blanks every ASCII byte that is no letter or digit (``bytes.translate``), so that
``bytes.split`` yields the words; bytes of other characters stay. Runs of 1 to ``max_n`` words are hashed by chained
``zlib.crc32``: the hash of a run is the seed for the run one word longer, so no joined string is made. Counters over
hash buckets, one per task and at most ``buckets`` numbers each, are summed by Spark for the corpus and for the target.

A bucket's gain is the logarithm of its share in the target over its share in the corpus; a document's weight is the sum
of the gains of its features. Weights plus Gumbel noise that depends on the id alone make the highest scores a draw
without replacement. Scores are range-partitioned, so ranks need neither one task nor a global window; equal keys are
split, too, as the number of the row in the stored table is the last key.

Edge cases: null and empty texts have no words, weight 0, and are not drawn; very long texts are hashed in slices whose
n-grams run on over the cuts; a null id has a weight, but no score, and is neither drawn nor counted among the candidates;
repeated rows are rows of their own, equal scores rank by id, and equal ids in any order; an empty corpus gives an empty
result, an empty target counts as nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import release, shuffle_partitions, stored

#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
#: Rows of a range of scores that are ranked in one task.
RANGE_ROWS = 1 << 20


def hashes(data: bytes, max_n: int = 3, size: int = SLICE) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of every run of 1 to ``max_n`` words that ends in the slice) for each slice of a text."""
    text = data.translate(TABLE)
    last: list[list[int]] = [[] for _ in range(max_n)]  # the hash of the run of k + 1 words that ended the slice before
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + size)
        cut = len(text) if cut < 0 else cut
        words = text[at:cut].split()
        at = cut
        if not words:
            continue
        spaced = [b" " + w for w in words]
        level = list(map(zlib.crc32, words))
        found = level
        for k in range(max_n):
            before, last[k] = last[k], level[-1:] or last[k]
            if k + 1 == max_n:
                break
            seeds = before + level[:-1]
            level = list(map(zlib.crc32, spaced[len(spaced) - len(seeds) :], seeds))
            found = found + level
        yield len(words), found


def in_buckets(found: list[int], buckets: int) -> np.ndarray:
    return np.fromiter(found, np.uint32, len(found)) % np.uint32(buckets)


def _texts(df: DataFrame, text_col: str, *others: Column) -> DataFrame:
    return df.select(*others, F.col(text_col).cast("binary").alias("text"))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000, max_n: int = 3) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each hash bucket; empty buckets are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        waiting: list[int] = []

        def reduce() -> None:
            n = np.bincount(in_buckets(waiting, buckets), minlength=buckets)
            seen.update({int(b): int(n[b]) for b in np.flatnonzero(n)})
            waiting.clear()

        for batch in batches:
            for text in batch.column("text"):
                for _, found in hashes(text.as_py() or b"", max_n):
                    waiting += found
                    if len(waiting) >= SLICE:
                        reduce()
        reduce()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    return _texts(df, text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from the counts of both sides: ``buckets`` numbers, whatever the size of the corpus."""
    both = []
    for counts in (corpus, target):
        n = [0] * buckets
        for row in counts.collect():
            n[row["bucket"]] = row["n"]
        both.append(n)
    s, t = both
    s_all, t_all = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(y + 1) * s_all) / (float(x + 1) * t_all))) for x, y in zip(s, t)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    schema = "doc_id long, n_words long, n_features long, weight long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = features = weight = 0
                for n, found in hashes(text.as_py() or b"", max_n):
                    words += n
                    features += len(found)
                    weight += int(gain[in_buckets(found, len(gain))].sum())
                out.append((words, features, weight))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return _texts(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(weigh, schema)


def noise(id_col: str = "doc_id", seed: int = 42) -> Column:
    """Gumbel noise of an id in thousandths: the same for an id in every run, null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, max_n: int = 3,
             seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for rows not drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn, those of the highest scores.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, max_n), bucket_counts(target, target_col, buckets, max_n), buckets)
    # The table is stored with a number for every row: the passes below must see the same order.
    scored = stored(weighted(docs, gain, id_col, text_col, max_n).select(
        "*", (F.col("weight") + noise("doc_id", seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    candidate = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    rows, n = scored.agg(F.count("*"), F.count_if(candidate)).first()
    drawn = percent * n // 100
    order = [F.desc("candidate"), F.desc_nulls_last("score"), F.asc("doc_id"), F.asc("row")]
    parts = max(shuffle_partitions(docs.sparkSession), -(-rows // RANGE_ROWS))
    ranged = stored(scored.withColumn("candidate", candidate).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    release(scored)
    # Ranges ascend with their number; one count for each of them gives where it starts.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count_if("candidate").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # A row for each range: at most one per partition of the shuffle above.
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = F.when(F.col("candidate") & (F.col("place") <= drawn), F.col("place")).cast("long")
    return ranged.join(F.broadcast(starts), "part").withColumn("place", place).select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
