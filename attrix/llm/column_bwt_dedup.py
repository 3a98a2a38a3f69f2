"""Duplicate byte strings by column-wise construction of Burrows-Wheeler order and common prefixes.

Every byte that a ``WINDOW``-byte string covers which also starts anywhere else, in the same document or another,
is removed. Strings never cross documents.

A suffix array of the whole corpus in one place would not scale, so the collection is cut into many small ones that
cannot share a repeated window:

1. *Anchors*: every window elects the byte phrase of least hash in it. Equal windows elect equal phrases; phrases
   elected at one place only are dropped. Neighbouring windows with one elected phrase form a segment of at most
   ``2 * WINDOW`` bytes.
2. *Columns*: equal segments are counted once (copies collapse before the shuffle). The distinct segments of a phrase
   are lined up at it, and the collection is built as in multi-document construction: one round per column, from the
   last byte to the first, inserts one symbol of every segment, updates the order of all suffixes by a stable sort on
   that symbol (the Burrows-Wheeler permutation) and the common prefix of each suffix with its predecessor. Rounds
   are bounded by the segment length and each costs one pass over the segments; all collections of a shard advance
   together. A window repeats if its suffix shares ``WINDOW`` bytes with a neighbour in that order, or if its
   segment has copies.
3. *Hot phrases* (more than ``HOT`` distinct segments) would make an unbounded collection: the windows of their
   segments are counted by 128-bit hashes instead, an aggregation that collapses on the map side and needs no group in
   one task.
4. *Cut*: repeated windows return to their document's block, which cuts the bytes.

The columns of a shard (a few MB by construction) are held in memory; the tables between the steps are sequential
files on shared storage.

Edge cases: a null text is empty; a text under ``WINDOW`` bytes is kept whole; rows equal in id and text count as one
document (an id is taken to name one text); a text with a null id is kept whole and matches nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import BYTE, Rolling, block_of, copies, release, shuffle_partitions, sliding_min, stored, with_blocks

WINDOW = 200
PHRASE = 32
HOT = 20_000
SHARD_BYTES = 4 << 20
END = 256  # the symbol of a column that a segment does not reach


def _elected(data: bytes, window: int, phrase: int) -> tuple[Rolling, np.ndarray, np.ndarray]:
    roll = Rolling(BYTE[np.frombuffer(data, np.uint8)])
    grams = roll.windows(phrase)
    return roll, grams, sliding_min(grams, window - phrase + 1)


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _scan(window: int, phrase: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, np.int32)]
            for doc, text, block in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block"))):
                data = text.encode() if text and doc is not None else b""
                if len(data) < window:
                    continue
                _, grams, least = _elected(data, window, phrase)
                # A window that begins with its phrase, before one with the same phrase: the phrase has a second place.
                again = np.flatnonzero((grams[: len(least) - 1] == least[:-1]) & (least[1:] == least[:-1]))
                value, n = np.unique(np.concatenate([least[_firsts(least)], least[again]]), return_counts=True)
                keys.append(value)
                places.append(n)
                blocks.append(np.full(len(value), block, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(blocks))], ["phrase", "places", "block"])
    return scan


def recurring_phrases(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(block, phrase): phrases elected at two places or more, once for each block that has them."""
    return (docs.mapInArrow(_scan(window, phrase), "phrase long, places int, block int")
            .groupBy("phrase").agg(F.sum("places").alias("places"), F.collect_set("block").alias("blocks"))
            .where("places > 1").select(F.explode("blocks").alias("block"), "phrase"))


PIECES = "phrase long, segment_id binary, lead int, segment binary, doc_id long, starts array<int>"


def _segments(window: int, phrase: int):
    """Segments of recurring phrases."""
    width = window - phrase + 1

    def segments(docs: pa.Table, side: pa.Table) -> pa.Table:
        skip = set(side["doc_id"].drop_null().to_pylist())
        known = side.filter(pc.is_valid(side["phrase"])).sort_by("phrase")
        keys = known["phrase"].to_numpy()
        rows, done = [], set()
        for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()) if len(keys) else ():
            data = text.encode() if text and doc is not None and doc not in skip else b""
            if len(data) < window or (doc, text) in done:
                continue
            done.add((doc, text))
            _, grams, least = _elected(data, window, phrase)
            first = _firsts(least)
            last = np.append(first[1:], len(least))
            value = least[first].view(np.int64)
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            repeats = {}
            for i in np.flatnonzero(keys[at] == value).tolist():
                v, s, e = int(value[i]), int(first[i]), int(last[i])
                place = s + np.flatnonzero(grams[s : e - 1 + width] == least[s])
                if len(place) == 1:
                    piece = data[s : e - 1 + window]
                    rows.append((v, hashlib.md5(piece).digest(), int(place[0]) - s, piece, doc, [s]))
                    continue
                # Leftmost place per window, so that equal windows have equal leads; equal pieces of a document share a row.
                lo = s
                for p in place.tolist():
                    if lo < e:
                        hi = min(p + 1, e)
                        repeats.setdefault((v, p - lo, data[lo : hi - 1 + window]), []).append(lo)
                        lo = hi
            rows += [(v, hashlib.md5(piece).digest(), lead, piece, doc, starts) for (v, lead, piece), starts in repeats.items()]
        a = list(zip(*rows)) or [()] * 6
        kinds = pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32())
        return pa.table([pa.array(x, k) for x, k in zip(a, kinds)], ["phrase", "segment_id", "lead", "segment", "doc_id", "starts"])
    return segments


def repeated_columns(group: np.ndarray, lead: np.ndarray, segments: list[bytes], window: int) -> np.ndarray:
    """Mask (segment, offset): the window at that offset also starts in another segment of the group.

    ``group`` is ascending. Segments are lined up at their lead; each round inserts the column before and keeps the
    order of all suffixes and the common prefix of each with the one before it.
    """
    m, size = len(segments), np.array([len(x) for x in segments])
    most, columns = int(lead.max()), int((size - lead).max() + lead.max())
    symbol = np.full((m, columns), END, np.int16)
    for i, piece in enumerate(segments):
        symbol[i, most - lead[i] : most - lead[i] + len(piece)] = np.frombuffer(piece, np.uint8)
    symbol = np.ascontiguousarray(symbol.T)
    first, last = most - lead, most - lead + size - window
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    base = group.astype(np.int64) * 512
    found = np.zeros((m, columns), bool)
    for c in range(columns - 1, -1, -1):
        key = base[order] + symbol[c, order]
        sort = np.argsort(key, kind="stable")
        key, order = key[sort], order[sort]
        joined = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 != END)) + 1
        fresh = np.zeros(m + 1, np.int32)
        if len(joined):
            edges = np.empty(2 * len(joined), np.int64)
            edges[0::2], edges[1::2] = sort[joined - 1] + 1, sort[joined] + 1
            fresh[joined] = np.minimum.reduceat(common, edges)[0::2] + 1
        common = fresh
        best = np.maximum(common[:-1], common[1:])
        found[order, c] = (best >= window) & (first[order] <= c) & (c <= last[order])
    return np.stack([np.pad(found[i, first[i] :], (0, first[i])) for i in range(m)]) if m else found


def _shard(window: int):
    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("phrase")
        phrase, lead = table["phrase"].to_numpy(), table["lead"].to_numpy()
        segments, places = table["segment"].to_pylist(), table["places"].to_numpy()
        # A segment alone under its phrase has no other to meet; its copies decide.
        new = np.concatenate([[True], phrase[1:] != phrase[:-1]])
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1
        runs: list = [[0, len(x) - window] if n > 1 else None for x, n in zip(segments, places.tolist())]
        rest = np.flatnonzero(~alone)
        if len(rest):
            mask = repeated_columns(number[rest], lead[rest], [segments[i] for i in rest], window)
            for row, i in enumerate(rest.tolist()):
                if runs[i] is None and mask[row].any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask[row], [False]]).astype(np.int8)))
                    edge[1::2] -= 1
                    runs[i] = edge.tolist()
        out = pa.table({"phrase": table["phrase"], "segment_id": table["segment_id"], "lead": table["lead"], "runs": pa.array(runs, pa.list_(pa.int32()))})
        return out.filter(pc.is_valid(out["runs"]))
    return shard


def _window_hashes(window: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Rolling(BYTE[np.frombuffer(x, np.uint8)]).windows(window).view(np.int64) for x in batch.column("segment").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("phrase", "segment_id", "lead", "places")), pa.array(found, pa.list_(pa.int64()))], ["phrase", "segment_id", "lead", "places", "windows"])
    return hashes


def repeated_windows(distinct: DataFrame, window: int, hot: int) -> DataFrame:
    """(phrase, segment_id, lead, runs): first and last offset of each run of repeated windows of the distinct segments."""
    key = ["phrase", "segment_id", "lead"]
    schema = "phrase long, segment_id binary, lead int, runs array<int>"
    distinct = stored(distinct, "distinct")
    crowded = stored(distinct.groupBy("phrase").count().where(F.col("count") > hot).select("phrase"), "hot")
    total = distinct.agg(F.sum(F.octet_length("segment")).alias("n")).first()["n"] or 0
    shards = max(4 * shuffle_partitions(distinct.sparkSession), -(-total // SHARD_BYTES))
    some = not crowded.isEmpty()
    usual = distinct.join(crowded, "phrase", "left_anti") if some else distinct
    repeated = (usual.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)).cast("int")).groupBy("shard")
                .applyInArrow(_shard(window), schema))
    if not some:
        return repeated
    windows = (distinct.join(crowded, "phrase", "left_semi").mapInArrow(_window_hashes(window), "phrase long, segment_id binary, lead int, places long, windows array<long>")
               .select(*key, "places", F.posexplode("windows").alias("nth", "window")))
    twice = stored(windows.groupBy("phrase", "window").agg(F.sum("places").alias("n")).where("n > 1").drop("n"), "windows")
    return repeated.unionByName(windows.join(twice, ["phrase", "window"]).select(*key, F.array("nth", "nth").alias("runs")))


def _cut(window: int, with_text: bool):
    def cut(docs: pa.Table, side: pa.Table) -> pa.Table:
        whole, spans = set(), {}
        for doc, lo, hi in zip(side["doc_id"].to_pylist(), side["lo"].to_pylist(), side["hi"].to_pylist()):
            if lo is None:
                whole.add(doc)
            else:
                spans.setdefault(doc, []).append((lo, hi))
        rows = []
        for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
            data = text.encode() if text else b""
            n, kept, runs = len(data), data, 0
            if doc in whole and n >= window:
                kept, runs = b"", 1
            elif doc in spans:
                edge = np.zeros(n + 1, np.int32)
                lo, hi = np.array(spans[doc]).T
                np.add.at(edge, lo, 1)
                np.add.at(edge, np.minimum(hi, n), -1)
                gone = np.cumsum(edge[:n]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((doc, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        a = list(zip(*rows)) or [()] * 6
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([pa.array(x, k) for x, k in zip(a, kinds)][: 6 if with_text else 5], names[: 6 if with_text else 5])
    return cut


def column_bwt_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     phrase: int = PHRASE, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per input row, ``kept`` its remaining bytes."""
    docs, blocks = with_blocks(docs, id_col, text_col)
    same = stored(copies(docs).select("doc_id", (F.col("doc_id") > F.col("first_id")).alias("later"), block_of(blocks).alias("block")), "copies")
    side = recurring_phrases(docs, window, phrase).unionByName(same.where("later").select("block", "doc_id"), allowMissingColumns=True)
    pieces = stored(docs.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_segments(window, phrase), PIECES), "segments")

    distinct = pieces.groupBy("phrase", "segment_id", "lead").agg(F.first("segment").alias("segment"), F.sum(F.size("starts")).alias("places"))
    repeated = stored(repeated_windows(distinct, window, hot), "repeated")
    spans = (pieces.select("phrase", "segment_id", "lead", "doc_id", "starts").join(repeated, ["phrase", "segment_id", "lead"])
             .select("doc_id", "runs", F.explode("starts").alias("start"))
             .select("doc_id", "start", F.explode(F.expr("transform(sequence(0, size(runs) - 1, 2), i -> struct(runs[i] as lo, runs[i + 1] as hi))")).alias("r"))
             .select("doc_id", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi") + window).alias("hi")))
    spans = stored(spans, "spans")
    release(pieces, repeated)
    gone = spans.withColumn("block", block_of(blocks)).unionByName(same.select("doc_id", "block"), allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return docs.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_cut(window, with_text), schema)
