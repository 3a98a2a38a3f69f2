"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are tokenised (with an end token) and cut into full sequences and one rest each. The histogram of the rests is
all that the optimiser needs: lengths are counted in units of ``UNIT`` tokens, so it has at most ``size / UNIT`` rows
whatever the size of the corpus. Patterns of rests that fit into one sequence are the columns of a linear program; an
unbounded-knapsack dynamic program prices them against the duals until no column improves the program. The solution is
rounded down, the few rests left over (bounded by the program's size) fill sequences by exact subset sums, and the pieces
of each length, ranked within distributed buckets, take the places that the rounded patterns give to their length.

Only the histogram goes to the driver, and only the pattern table (at most a few thousand rows) is broadcast.

Edge cases: a null or empty text is the end token alone; a null id is packed like any other; repeated rows are packed
once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import documents, stored

SEQUENCE = 2048
UNIT = 8
END_ID = 1
#: Relative distance from the linear program's optimum at which columns are no longer added.
GAP = 1e-3
#: Rests that the greedy filling behind the first columns takes; exchanges without progress that end the program.
START, STALL = 4096, 2000
#: Pieces of one length per ranking bucket, about.
BUCKET = 10_000


@lru_cache(maxsize=2)
def encoding(tokenizer_file: str) -> tiktoken.Encoding:
    """The byte-level tokenizer of a ``tokenizers`` file, as ranks: its merges are ranked by the ids of what they make.

    tiktoken gives the same ids several times as fast. The file's added tokens, special or not, are found in plain text as
    ``tokenizers`` does by default (``allowed_special="all"``); a file whose added tokens tiktoken cannot match is refused.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], {t["content"]: t for t in content.get("added_tokens") or []}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()) or any(a != b and b.startswith(a) for a in added for b in added):
        raise ValueError(f"{tokenizer_file} has added tokens that take white space, stand alone only or begin another one")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    made = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if len(token) == 1 or token in made}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={c: t["id"] for c, t in added.items()})


def _tokenise(tokenizer_file: str, size: int, with_ids: bool):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(tokenizer_file)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = coder.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<i4") if with_ids else None))
            a = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(a, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)])
    return tokenise


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full sequences and a rest of every document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(_tokenise(tokenizer_file, size, with_ids), schema)


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of lengths within the capacity, by dynamic programming."""
    longest = int(lengths.max())
    worth, place = np.full(longest + 1, -1.0), np.zeros(longest + 1, int)
    worth[lengths], place[lengths] = values, np.arange(len(lengths))
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = min(c, longest)
        gain = worth[1 : k + 1] + best[c - 1 :: -1][:k]
        i = int(gain.argmax())
        best[c], last[c] = (gain[i], i + 1) if gain[i] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    column, c = np.zeros(len(lengths), int), capacity
    while c > 0:
        if last[c]:
            column[place[last[c]]] += 1
        c -= int(last[c]) or 1
    return float(best[capacity]), column


def filled(need: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """What rounding left over: each sequence takes the longest rest, then the lengths that fill it best, long ones first.

    The best filling is an exact subset sum over the lengths at hand, as bits of a number.
    """
    need, out = dict(need), []
    while need:
        content: dict[int, int] = {}
        first = max(need)
        room, reach, steps = capacity - first, 1, []
        lengths = sorted(need, reverse=True)
        for u in lengths:
            for _ in range(min(need[u] - (u == first), room // u)):
                if reach >> room & 1:
                    break
                steps.append((u, reach))
                reach |= (reach << u) & ((1 << room + 1) - 1)
        at = reach.bit_length() - 1
        taken = [first]
        for u, before in reversed(steps):
            if not before >> at & 1:
                taken.append(u)
                at -= u
        for u in taken:
            content[u] = content.get(u, 0) + 1
            need[u] -= 1
            if not need[u]:
                del need[u]
        out.append(content)
    return out


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and (fractional) times of a basis within ``GAP`` of the fewest sequences that take all rests.

    The first columns are the patterns of a greedy filling of the histogram, scaled to ``START`` rests so that it costs the
    same for any corpus; the program then is no worse than that filling before the first column is priced. Known columns
    enter first; the dynamic program prices a new one when none of them improves the program. Without progress for
    ``STALL`` exchanges the basis is taken as it is: the plan made from it places all rests in any case.

    The counts are perturbed by a hair, so that every exchange of a column makes progress; the times returned are those
    of the true counts.
    """
    m = len(lengths)
    place = {int(u): i for i, u in enumerate(lengths)}
    scaled = np.maximum(1, np.rint(counts * min(1.0, START / counts.sum()))).astype(int)
    known = sorted({tuple(sorted(x.items())) for x in filled(dict(zip(lengths.tolist(), scaled.tolist())), capacity)})
    pool = np.zeros((m, len(known)))
    for j, content in enumerate(known):
        for u, k in content:
            pool[place[u], j] = k
    patterns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    shifted = counts * (1 + 1e-5 * np.random.default_rng(0).random(m))
    x, floor = inverse @ shifted, lengths @ shifted / capacity
    best, since, turn = np.inf, 0, 0
    while since < STALL:
        duals = inverse.sum(axis=0)
        worth = duals @ pool
        column = pool[:, int(worth.argmax())]
        if worth.max() <= 1 + 1e-7:
            value, column = price(duals, lengths, capacity)
            # No solution is below the tokens to place, nor below the present one divided by the best column's value.
            if x.sum() <= (1 + GAP) * max(floor, x.sum() / value):
                break
            pool = np.column_stack([pool, column])
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        patterns[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        turn += 1
        if turn % 200 == 0:
            inverse = np.linalg.inv(patterns)
        x = np.maximum(inverse @ shifted, 0)
        best, since = (x.sum(), 0) if x.sum() < best * (1 - 1e-6) else (best, since + 1)
    x = np.maximum(np.linalg.solve(patterns, counts), 0)
    return [(patterns[:, j].astype(int), float(x[j])) for j in range(m)]


def pattern_table(histogram: dict[int, int], size: int = SEQUENCE, unit: int = UNIT) -> list[tuple[int, int, int, int, int]]:
    """(units, lo, hi, per_sequence, first_sequence): pieces of rank lo to hi - 1 of a length take these sequences."""
    counts: dict[int, int] = {}
    for length, n in histogram.items():
        counts[-(-length // unit)] = counts.get(-(-length // unit), 0) + n
    capacity = size // unit
    plan: list[tuple[dict[int, int], int]] = []
    if n := counts.pop(capacity, 0):
        plan.append(({capacity: 1}, n))
    lengths = np.array(sorted(counts), int)
    if len(lengths):
        need = np.array([counts[x] for x in lengths.tolist()], int)
        for column, times in column_generation(lengths, need.astype(float), capacity):
            used = column > 0
            whole = min(int(times + 1e-6), int((need[used] // column[used]).min()))
            if whole > 0:
                need = need - whole * column
                plan.append(({int(u): int(k) for u, k in zip(lengths, column) if k}, whole))
        plan += [(content, 1) for content in filled({u: k for u, k in zip(lengths.tolist(), need.tolist()) if k}, capacity)]
    table, taken, sequence = [], {}, 0
    for content, times in plan:
        for u, k in content.items():
            table.append((u, taken.get(u, 0), taken.get(u, 0) + k * times, k, sequence))
            taken[u] = taken.get(u, 0) + k * times
        sequence += times
    return table


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE,
         unit: int = UNIT, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece."""
    docs = documents(docs, id_col, text_col)
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, size, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row per length
    table = spark.createDataFrame(pattern_table(histogram, size, unit) or [(0, 0, 0, 1, 0)],
                                  "units int, lo long, hi long, per_sequence long, first_sequence long")
    # Rank of a piece among those of its units: longer first; buckets keep a frequent length out of one task.
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET))
    key = ["units", "length", "bucket"]
    cut = cut.withColumn("units", F.ceil(F.col("length") / unit).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("units").orderBy(F.desc("length"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = (cut.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "start", "ids_crc32")) - 1)
              .join(base, key).withColumn("rank", F.col("before") + F.col("nth")))
    placed = (ranked.join(F.broadcast(table), "units").where("lo <= rank and rank < hi")
              .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - lo) div per_sequence")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *(["ids"] if with_ids else []))
