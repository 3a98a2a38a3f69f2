"""Substring deduplication with repeated-phrase automata.

A passage repeats when a window of ``WINDOW`` consecutive words also starts in a document with a smaller id;
every word that such a window covers is removed. Four steps, each a distributed job:

1. *Confirm*: every window elects one short phrase (the one with the least hash among its ``PHRASE``-word
   phrases), so equal windows elect equal phrases. Phrases elected in two documents are confirmed.
2. *Compile and stream*: documents and confirmed phrases are dealt into blocks; each block compiles an
   Aho-Corasick automaton over the words of its own phrases and streams its documents through it, which
   locates every occurrence. A phrase is sent to a block once, however many documents there have it, and a
   document passes one automaton, so the work is linear in the text.
3. *Check*: windows whose elected phrase was located are grouped by (phrase, window) hashes, 128 bits
   together; the least document id is the window's origin.
4. *Cut*: windows with an origin in an earlier document go back to their block, which cuts the words.

Exact copies of a text follow from its first copy: they are removed whole and not streamed.

Edge cases: a null text has no words; a text of fewer than ``WINDOW`` words keeps all its words; a null id has no
order, so its text is kept whole and matches nothing; repeated rows of one id give one result row each and
never remove each other (an id is taken to name one text); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import Rolling, block_of, copies, covered, distinct, release, row_schema, sliding_min, stored, with_blocks, words_of

WINDOW = 50
PHRASE = 8


def _elected(hashes: np.ndarray, window: int, phrase: int) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Rolling hashes, phrase hashes by position, and the least phrase hash of each window."""
    roll = Rolling(hashes)
    grams = roll.windows(phrase)
    return roll, grams, sliding_min(grams, window - phrase + 1)


def _scan(window: int, phrase: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, phrases, ids, blocks = [], [], [], []
            for doc, text, block in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "block"))):
                data = text.encode() if text and doc is not None else b""
                hashes, starts, ends = words_of(data)
                if len(hashes) < window:
                    continue
                _, grams, least = _elected(hashes, window, phrase)
                value = distinct(least[np.concatenate([[True], least[1:] != least[:-1]])])
                # A place of each elected phrase: any one, as all hold the same words.
                order = np.argsort(grams)
                at = order[np.searchsorted(grams[order], value)]
                keys += value.view(np.int64).tolist()
                phrases += [b" ".join(data[s:e].split()) for s, e in zip(starts[at].tolist(), ends[at + phrase - 1].tolist())]
                ids += [doc] * len(value)
                blocks += [block] * len(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(phrases, pa.binary()), pa.array(ids, pa.int64()), pa.array(blocks, pa.int32())], ["phrase_hash", "phrase", "doc_id", "block"])
    return scan


def confirmed_phrases(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(block, phrase_hash, phrase): phrases elected in two documents or more, once for each block that has them."""
    found = docs.mapInArrow(_scan(window, phrase), "phrase_hash long, phrase binary, doc_id long, block int")
    return (found.groupBy("phrase_hash", "phrase")
            .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.collect_set("block").alias("blocks"))
            .where("lo < hi").select("phrase_hash", "phrase", F.explode("blocks").alias("block")))


#: A word number is written as so many symbols of so many bits: nodes of the automaton keep their children in a list,
#: so a small alphabet keeps every step short.
SYMBOLS, BITS = 4, 5


def _written(numbers: np.ndarray) -> str:
    """Word numbers as a string, ``SYMBOLS`` characters each."""
    digits = (numbers[:, None] >> (BITS * np.arange(SYMBOLS))) & ((1 << BITS) - 1)
    return (digits + 1).astype(np.uint8).tobytes().decode("latin-1")


class Phrases:
    """An Aho-Corasick automaton over the words of some phrases; words are numbered, 0 is any word of no phrase."""

    def __init__(self, phrases: list[bytes], length: int):
        hashes = words_of(b" ".join(phrases))[0]
        self.known = distinct(hashes)
        numbers = np.searchsorted(self.known, hashes).reshape(-1, length) + 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for row in numbers:
            self.machine.add_word(_written(row))
        self.machine.make_automaton()

    def ends(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the last word of every phrase occurrence; matches off the word grid are none."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        numbers = np.where(self.known[at] == hashes, at + 1, 0)
        found = np.array([e for e, _ in self.machine.iter(_written(numbers))], int)
        return found[found % SYMBOLS == SYMBOLS - 1] // SYMBOLS


def _stream(window: int, phrase: int):
    def stream(docs: pa.Table, side: pa.Table) -> pa.Table:
        known = side.filter(pc.is_valid(side["phrase"]))
        skip = set(side.filter(pc.is_null(side["phrase"]))["doc_id"].to_pylist())
        keys, ids, starts, wins = [], [], [], []
        done = set()
        machine = Phrases(known["phrase"].to_pylist(), phrase) if len(known) else None
        for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()) if machine else ():
            if not text or doc is None or doc in skip or (doc, text) in done:
                continue
            done.add((doc, text))
            hashes = words_of(text.encode())[0]
            if len(hashes) < window:
                continue
            ends = machine.ends(hashes)
            if not len(ends):
                continue
            roll, grams, least = _elected(hashes, window, phrase)
            located = np.full(len(grams), np.iinfo(np.uint64).max)
            at = ends - phrase + 1
            located[at] = grams[at]
            hit = np.flatnonzero(sliding_min(located, window - phrase + 1) == least)
            if not len(hit):
                continue
            value, whole = least[hit], roll.windows(window)[hit].view(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (hit[1:] != hit[:-1] + 1)]))
            keys += value[cut].view(np.int64).tolist()
            ids += [doc] * len(cut)
            starts += hit[cut].tolist()
            wins += np.split(whole, cut[1:])
        return pa.table({"phrase_hash": pa.array(keys, pa.int64()), "doc_id": pa.array(ids, pa.int64()),
                         "start": pa.array(starts, pa.int32()), "windows": pa.array(wins, pa.list_(pa.int64()))})
    return stream


def locate(docs: DataFrame, phrases: DataFrame, later: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(phrase_hash, doc_id, start, windows): runs of windows around located phrases, with their hashes.

    ``later``: (block, doc_id) of exact copies of an earlier document, which are not streamed.
    """
    side = phrases.select("block", "phrase_hash", "phrase", F.lit(None).cast("long").alias("doc_id")).unionByName(
        later.select("block", "doc_id"), allowMissingColumns=True)
    return (docs.groupBy("block").cogroup(side.groupBy("block"))
            .applyInArrow(_stream(window, phrase), "phrase_hash long, doc_id long, start int, windows array<long>"))


def _cut(window: int, with_text: bool):
    def cut(docs: pa.Table, side: pa.Table) -> pa.Table:
        whole = set(side.filter(pc.is_null(side["start"]))["doc_id"].to_pylist())
        part = side.filter(pc.is_valid(side["start"])).sort_by("doc_id")
        owner, start = part["doc_id"].to_numpy(), part["start"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
        starts = dict(zip(owner[at].tolist(), np.split(start, at[1:])))
        total, removed, digests, kept = [], [], [], []
        for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
            words = text.encode().split() if text else []
            n = len(words)
            if doc in whole and n >= window:
                words = []
            elif doc in starts:
                words = [w for w, gone in zip(words, covered(starts[doc], window, n).tolist()) if not gone]
            rest = b" ".join(words)
            total.append(n)
            removed.append(n - len(words))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if len(words) < n else text)
        columns = {"doc_id": docs["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.string()), "row": docs["row"]} if with_text else {}))
    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    phrase: int = PHRASE, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept, row]): one row per input row.

    ``kept`` is the text itself if nothing was removed, else the remaining words joined by a space (which the digest is
    of in either case); ``row`` has the input columns.
    """
    whole, blocks = with_blocks(docs, id_col, text_col, with_text)
    docs = whole.select("doc_id", "text", "block")
    later = stored(copies(docs).where("doc_id > first_id").select("doc_id", block_of(blocks).alias("block")), "copies")
    runs = stored(locate(docs, confirmed_phrases(docs, window, phrase), later, window, phrase), "windows")
    windows = (runs.select("phrase_hash", "doc_id", "start", F.posexplode("windows").alias("nth", "window"))
               .select("phrase_hash", "window", "doc_id", (F.col("start") + F.col("nth")).alias("start")))
    # Stored, so that the join below has exchanges of its own, whose hot windows can be split.
    origin = stored(windows.groupBy("phrase_hash", "window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
                    .where("first_id < last_id").drop("last_id"), "origins")
    gone = (windows.join(origin, ["phrase_hash", "window"]).where("doc_id > first_id")
            .select("doc_id", "start", block_of(blocks).alias("block")))
    gone = stored(gone, "gone")
    release(runs, origin)
    side = gone.unionByName(later, allowMissingColumns=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" + row_schema(whole) if with_text else "")
    return whole.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_cut(window, with_text), schema)
