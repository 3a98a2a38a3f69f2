"""Exact Jaccard self-join of word shingle sets by a partitioned universe and the pigeonhole principle.

Two sets of sizes x and y with Jaccard similarity t or more differ in at most H = (1 - t) / (1 + t) * (x + y) shingles.
Hashing splits the universe of shingles into segments, so a set becomes one subset per segment and the differences of
the segments add up to H at most. If segment i is given the budget v_i and the budgets sum to H + 1, some segment
differs in fewer than v_i shingles. With v_i = 1 its subsets are equal: one signature. With v_i = 2 they are equal or
one deletion apart: a signature of the subset and one of each one-deletion neighbour.

* Sizes fall into bands; a set signs in its own band and, if it can match a larger set there, in the next one, so the two
  sets of a pair share a band whose H and segments follow from the band alone.
* The allocation of budgets per band is cost-based: over all mixes of segments with budgets 1 and 2 it takes the one of
  least cost, counting the signatures written and the expected candidates to verify, given the band's document count.
* Spare segments let a set leave out its empty subsets, which would be signatures of very many sets. A set with more
  empty subsets than spares signs those, too; then so does every partner that has nothing else in common with it.

Copies are one node of the join. Signatures that two different sets have give candidates: the least node of each
signature is compared with the others (a star, not all pairs), pairs are verified on the whole sets, and components are
built. Signatures whose nodes then lie in different components are taken up again, in tiles of bounded size: a task
compares the parity bitmaps of all nodes of different components and emits a spanning forest of the pairs that may
link, and all that are close to the threshold; these are verified. Where components still differ afterwards, signatures
of which pairs were left out are gone through again, and these pairs are verified. So no link between different texts is lost for the components, and copies or near
copies in thousands need no quadratic output.

Disk: signatures meet, and their nodes are compared in tiles, in passes over shares of the signatures; whole sets are made for the pairs whose bitmaps leave a link
possible, in passes over shares of the pairs. A pass shuffles its share, writes what it found and frees the rest; small tables
need one pass over tiles and whole sets.

Edge cases: a document with fewer words than a shingle has one shingle, its whole sequence; one without words (or with
a null text) has the empty set and links with nothing; a null id links with nothing and has a null component; repeated
rows get one result row each (an id is taken to name one text); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm.common import Rolling, distinct, documents, release, scrambled, shuffle_partitions, stored, words_of
from attrix.llm.components import connected_components

WORDS = 4
PERCENT = 85
BAND_RATIO = 1.6
#: Signatures that one verification costs (most end at a bitmap), and the share of shingles taken to be common, in the cost of an allocation.
VERIFY_COST, COMMON_SHARE = 2.0, 0.05
#: Bands that the documents are taken to spread over, for the same purpose.
BANDS_IN_USE = 12
#: Nodes of a signature that are compared with each other in one task.
TILE = 1024
#: Slack of a bitmap's bound, per shingle of both sets, below which a pair is verified in any case.
CLOSE = 1.0
#: Partners of one node that are verified together, and bytes of sets per verifying group.
PARTNERS, GROUP_BYTES = 256, 4 << 20
#: Passes over the signatures, and over the pairs whose bitmaps or whole sets are compared: as many as bring a pass to ``PASS_BYTES``, this many at most.
PASSES, PASS_BYTES = 4, 256 << 20
#: Ids that a semi-join broadcasts at most (8 bytes each); beyond it the text is shuffled.
BROADCAST_IDS = 500_000


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles, A-Z lower-cased."""
    hashes = words_of(text.encode().lower() if text else b"")[0]
    if len(hashes) < words:
        return scrambled(Rolling(hashes).windows(len(hashes)) + np.uint64(len(hashes))) if len(hashes) else hashes
    return distinct(Rolling(hashes).windows(words))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def set_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


class Band:
    """Segments of a size band [low, high): the first ``ones`` have budget 1, the ``twos`` after them budget 2."""

    def __init__(self, low: int, high: int, percent: int, documents: float):
        self.low, self.high = low, high
        self.differences = (100 - percent) * 2 * (high - 1) // (100 + percent)
        # Without differences all segments are equal; one holds the whole set.
        self.spare = 0 if not self.differences else 2 + math.ceil(0.06 * (self.differences + 1))
        need = self.differences + 1 + self.spare

        def partners(mass: float) -> float:
            """Expected other documents with the same subset: it has common shingles only, they have the same ones."""
            rare = math.exp(-mass * (1 - COMMON_SHARE))
            return documents * COMMON_SHARE * rare * (rare - math.exp(-mass))

        mass = (low + high - 1) / 2 / need  # mean shingles of a segment with budget 1; budget 2 has twice as many
        costs = []
        for twos in range(need // 2 + 1):
            ones = need - 2 * twos
            costs.append((ones * (1 + VERIFY_COST * partners(mass)) + twos * (2 + 2 * mass) * (1 + VERIFY_COST * partners(2 * mass)), ones, twos))
        _, self.ones, self.twos = min(costs)
        self.seed = np.uint64((low * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)

    def signatures(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and whether each is of a whole subset (not of a one-deletion neighbour)."""
        count, need = self.ones + self.twos, self.ones + 2 * self.twos
        slot = (scrambled(shingles ^ self.seed) % np.uint64(need)).astype(np.int64)
        segment = np.where(slot < self.ones, slot, self.ones + (slot - self.ones) // 2)
        mixed = scrambled(shingles + self.seed)
        sums, sizes = np.zeros(count, np.uint64), np.bincount(segment, minlength=count)
        np.add.at(sums, segment, mixed)
        base = scrambled(np.arange(1, count + 1, dtype=np.uint64) ^ self.seed)
        # Empty subsets take their budgets out of the spare ones, if these suffice.
        empty = sizes == 0
        lost = int(empty[: self.ones].sum() + 2 * empty[self.ones :].sum())
        signed = ~empty if lost <= self.spare else np.ones(count, bool)
        whole = scrambled(sums + base)[signed]
        if not self.twos:
            return whole, np.ones(len(whole), bool)
        near = segment >= self.ones
        less = sizes[segment] > (1 if lost <= self.spare else 0)
        near &= less
        parts = scrambled(sums[segment[near]] - mixed[near] + base[segment[near]])
        return np.concatenate([whole, parts]), np.repeat([True, False], [len(whole), len(parts)])


def band_edges(ratio: float = BAND_RATIO) -> Iterator[tuple[int, int]]:
    low = 1
    while True:
        high = max(low + 1, int(low * ratio))
        yield low, high
        low = high


class Bands:
    """The bands that sets of some size sign in, made as they are met."""

    def __init__(self, percent: int, documents: int):
        self.percent, self.documents = percent, documents / BANDS_IN_USE
        self.edges, self.bands = band_edges(), []

    def of(self, size: int) -> list[Band]:
        while not self.bands or 100 * size >= self.percent * self.bands[-1].high:
            self.bands.append(Band(*next(self.edges), self.percent, self.documents))
        return [b for b in self.bands if size < b.high and 100 * size >= self.percent * b.low]


def _scan(percent: int, documents: int, words: int):
    """Two kinds of rows: (doc_id, n_shingles, digest, key) per document and (key, signature, whole) per signature."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, documents)
        for batch in batches:
            sizes, digests, seen = [], [], set()
            keys, signatures, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(text, words)
                digest = set_digest(s)
                sizes.append(len(s))
                digests.append(digest)
                if doc is None or not len(s) or digest in seen:
                    continue
                seen.add(digest)
                for band in bands.of(len(s)):
                    x, full = band.signatures(s)
                    keys.append(np.full(len(x), set_key(digest), np.int64))
                    signatures.append(x)
                    whole.append(full)
            n, m = len(sizes), sum(map(len, keys))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(batch.column("doc_id")), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(digests, pa.binary()), pa.nulls(m, pa.binary())]),
                pa.array(np.concatenate([np.array([set_key(d) for d in digests], np.int64), *keys])),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(signatures).view(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.bool_()), pa.array(np.concatenate(whole))])],
                ["doc_id", "n_shingles", "digest", "key", "signature", "whole"])
    return scan


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: bit i tells whether an odd number of shingles fall on i. A power of two of 64-bit words, 2 to 4 bits a shingle.

    Two bitmaps differ in at most as many bits as the sets differ in shingles, also when a larger one is folded.
    """
    bits = 64 << max(0, (len(shingles) - 1) // 32).bit_length()
    odd = np.bincount((scrambled(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _sets(words: int, payload: str):
    """(node, key, payload): the whole set ("shingles") or its size and bitmap ("bits")."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
            made = [s.tobytes() if payload == "shingles" else len(s).to_bytes(8, "little") + parity_bits(s).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([set_key(set_digest(s)) for s in found], pa.int64()), pa.array(made, pa.binary())], ["node", "key", payload])
    return sets


def sets_of(docs: DataFrame, repeated: bool, nodes: DataFrame, words: int, payload: str) -> DataFrame:
    """The sets of the nodes, made from their texts and stored; texts are shuffled only if some id has several rows."""
    found = matching_ids(docs, nodes.select(F.col("node").alias("doc_id")))
    return stored((found.dropDuplicates(["doc_id"]) if repeated else found)
                  .mapInArrow(_sets(words, payload), f"node long, key long, {payload} binary"), payload)


def _may_link(percent: int):
    """Key pairs whose sizes and parity bitmaps leave a link possible."""
    def may_link(a: bytes, b: bytes) -> bool:
        x, y = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
        if 100 * min(x, y) < percent * max(x, y):
            return False
        p, q = np.frombuffer(a, np.uint64, offset=8), np.frombuffer(b, np.uint64, offset=8)
        if len(p) != len(q):
            least = min(len(p), len(q))
            p, q = folded(p, least), folded(q, least)
        # percent of the union in common: the sets differ in (100 - percent) / (100 + percent) of their sizes' sum at most.
        return int(np.bitwise_count(p ^ q).sum()) * (100 + percent) <= (100 - percent) * (x + y)
    return may_link


def _do_link(percent: int):
    """Whole sets compared."""
    def do_link(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        same = int((x[at] == y).sum())
        return 100 * same >= percent * (len(x) + len(y) - same)
    return do_link


def _compare(test, result: str):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        mine: dict[int, list] = {}
        for a, out, payload in zip(left["a"].to_pylist(), left[result].to_pylist(), left["payload"].to_pylist()):
            mine.setdefault(a, []).append((out, payload))
        links = set()
        for a, out, payload in zip(right["a"].to_pylist(), right[result].to_pylist(), right["payload"].to_pylist()):
            links.update((other, out) for other, x in mine.get(a, ()) if test(x, payload))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*links) if links else ((), ()))], ["a", "b"])
    return compare


def bytes_sent(sent: DataFrame, sets: DataFrame, payload: str) -> int:
    """Bytes of the payloads of which each (key, times) row sends so many copies."""
    sizes = sets.select("key", F.octet_length(payload).alias("bytes"))
    return sent.groupBy("key").agg(F.sum("times").alias("times")).join(sizes, "key").agg(F.sum(F.col("times") * F.col("bytes")).alias("n")).first()["n"] or 0


def groups_for(size: int, sets: DataFrame) -> int:
    """Groups of about ``GROUP_BYTES`` for payloads of this size."""
    return max(4 * shuffle_partitions(sets.sparkSession), -(-size // GROUP_BYTES))


def passes_for(size: int) -> int:
    return min(PASSES, max(1, -(-size // PASS_BYTES)))


def compared(pairs: DataFrame, sets: DataFrame, payload: str, test, result: str) -> DataFrame:
    """(a, b): ``result`` of the sets whose key pairs (a, b) pass the test on their payloads.

    Pairs are grouped by their first key; a key with very many partners is split, with its payload sent to each part.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    sent = parts.select(F.col("a").alias("key"), F.col("parts").alias("times")).unionAll(pairs.groupBy(F.col("b").alias("key")).agg(F.count("*").alias("times")))
    groups = groups_for(bytes_sent(sent, sets, payload), sets)
    pairs = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    group = F.pmod(F.xxhash64("a", "part"), F.lit(groups)).cast("int").alias("g")
    # Both sides read one table; aliases tell them apart.
    fresh = [F.col("g").alias("g"), F.col("a").alias("a"), F.col("other" if result == "key" else "node").alias(result), F.col(payload).alias("payload")]
    sets = sets.select("key", "node", payload, F.col("key").alias("other"))
    left = pairs.select("a", "part", group).distinct().join(sets.withColumnRenamed("key", "a"), "a").select(*fresh)
    right = pairs.select("a", "b", group).join(sets.withColumnRenamed("key", "b"), "b").select(*fresh)
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_compare(test, result), "a long, b long")


def _tile_pairs(percent: int, everything: bool):
    """(a, b): keys of nodes of one signature and different components whose bitmaps leave a link possible.

    First a spanning forest of them, the likeliest first, and all that are close to the bound; (signature, null) tells that
    pairs of that signature were left out. ``everything``: all that are not close, as the close ones went before.
    """
    def near(mine: np.ndarray, other: np.ndarray, words: np.ndarray, sizes: np.ndarray, part: np.ndarray, same: bool) -> list[tuple[float, int, int]]:
        found = []
        for k, i in enumerate(mine.tolist()):
            js = other[k + 1 :] if same else other
            js = js[part[js] != part[i]]
            if not len(js):
                continue
            both = sizes[js] + sizes[i]
            # Slack of the bound on differing shingles; sizes that differ too much have none.
            slack = (100 - percent) * both - np.bitwise_count(words[js] ^ words[i]).sum(axis=1, dtype=np.int64) * (100 + percent)
            slack = np.where(100 * np.minimum(sizes[js], sizes[i]) < percent * np.maximum(sizes[js], sizes[i]), -1, slack)
            found += [(float(s) / float(b), i, j) for s, b, j in zip(slack[slack >= 0], both[slack >= 0], js[slack >= 0].tolist())]
        return found

    def tile_pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("signature", "ascending"), ("i", "ascending"), ("j", "ascending")])
        signature, i, j, tile, key, part = (table[c].to_numpy() for c in ("signature", "i", "j", "tile", "key", "part"))
        bits = table["bits"].to_pylist()
        cut = np.flatnonzero(np.concatenate([[True], (signature[1:] != signature[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        pairs, left_out = set(), set()
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
            if len(np.unique(part[lo:hi])) < 2:
                continue
            raw = [np.frombuffer(x, np.uint64, offset=8) for x in bits[lo:hi]]
            width = min(map(len, raw))
            words = np.stack([x if len(x) == width else folded(x, width) for x in raw])
            sizes = np.array([int.from_bytes(x[:8], "little") for x in bits[lo:hi]])
            here, t, parts = key[lo:hi], tile[lo:hi], part[lo:hi]
            mine = np.flatnonzero(t == i[lo])
            found = near(mine, mine if i[lo] == j[lo] else np.flatnonzero(t == j[lo]), words, sizes, parts, i[lo] == j[lo])
            root = {p: p for p in parts.tolist()}

            def top(x: int, root: dict = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for slack, x, y in sorted(found, reverse=True):
                p, q = top(int(parts[x])), top(int(parts[y]))
                if everything and slack < CLOSE:
                    continue
                if everything or p != q or slack < CLOSE:
                    pairs.add((int(min(here[x], here[y])), int(max(here[x], here[y]))))
                    root[p] = q
                else:
                    left_out.add((int(signature[lo]), None))
        rows = [*pairs, *left_out]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), ()))], ["a", "b"])
    return tile_pairs


def tiles() -> Column:
    return F.ceil(F.col("n") / TILE).cast("int")


def dealt_tiles(groups: DataFrame, sets: DataFrame, size: int | None, near: str) -> DataFrame:
    """(signature, key, part, tile, i, j, g): the nodes of every tile, with the group that compares it.

    A pair may share very many signatures. Those of one ``near``, a column of the nodes, meet in as few groups as their
    bytes allow, and a group finds the pair once.
    """
    dealt = groups.withColumn("near", F.col(near)).withColumn("tiles", tiles()).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("near", "signature", "key", "part", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    size = bytes_sent(groups.select("key", tiles().alias("times")), sets, "bits") if size is None else size
    sent = groups.groupBy(F.col(near).alias("near")).agg(F.sum(tiles()).alias("times"))
    total = sent.agg(F.sum("times").alias("n")).first()["n"] or 1
    # Only what exceeds a group is listed and broadcast, so the list is shorter than that of the groups.
    split = sent.select("near", F.ceil(F.col("times") * (size / total / GROUP_BYTES)).alias("splits")).where("splits > 1")
    shards = F.lit(groups_for(size, sets))
    # Neighbouring groups, so that no two parts of one split meet again.
    part = F.pmod(F.xxhash64("signature", "i", "j"), F.coalesce("splits", F.lit(1)))
    return dealt.join(F.broadcast(split), "near", "left").withColumn("g", F.pmod(F.pmod(F.xxhash64("near"), shards) + part, shards).cast("int")).drop("near", "splits")


def possible_pairs(groups: DataFrame, sets: DataFrame, percent: int, everything: bool, size: int | None = None, near: str = "signature") -> DataFrame:
    """(a, b): key pairs to verify among the nodes (signature, key, part, n) of signatures with several components, and
    (signature, null) where pairs were left out.

    ``size``: bytes of bitmaps that their tiles get, if known.
    """
    return (dealt_tiles(groups, sets, size, near).join(sets.select("key", "bits"), "key")
            .groupBy("g").applyInArrow(_tile_pairs(percent, everything), "a long, b long").distinct())


def share(column: str, k: int, passes: int) -> Column:
    """Rows of pass k."""
    return F.pmod(F.xxhash64(column, F.lit(1)), F.lit(passes)) == k


def verified(likely: DataFrame, set_bytes: float, docs: DataFrame, repeated: bool, nodes: DataFrame, words: int, percent: int) -> list[DataFrame]:
    """(a, b): node pairs of the key pairs (a, b) whose whole sets, of about ``set_bytes`` each, are similar enough; a table per pass."""
    links, count = [], likely.count()
    passes = passes_for(int(2 * count * set_bytes))
    for k in range(passes if count else 0):
        pairs = stored(likely.where(share("a", k, passes)), "pairs") if passes > 1 else likely
        if passes == 1 or not pairs.isEmpty():
            keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
            met = stored(nodes.join(keys, "key"), "met")
            sets = sets_of(docs, repeated, met, words, "shingles")
            links.append(stored(compared(pairs, sets, "shingles", _do_link(percent), "node"), "links"))
            release(sets, met)
        if passes > 1:
            release(pairs)
    return links


def all_of(links: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], "a long, b long")


def matching_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose id is (or, by "left_anti", is not) in ids.

    A list of checked size is broadcast, a longer one is shuffled with the rows.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def shingle_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row; components of the links of ``percent`` or more."""
    docs = documents(docs, id_col, text_col)
    scanned = stored(docs.mapInArrow(_scan(percent, docs.count(), words), "doc_id long, n_shingles long, digest binary, key long, signature long, whole boolean"), "sets")
    table = stored(scanned.where("signature is null").select("doc_id", "n_shingles", "digest", "key"), "documents")
    classes = stored(table.where("doc_id is not null and n_shingles > 0").groupBy("digest", "key", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    parts = []
    for k in range(PASSES):
        signatures = scanned.where("signature is not null").where(share("signature", k, PASSES)).select("signature", "key", "whole")
        shared = stored(signatures.groupBy("signature").agg(F.min("key").alias("pivot"), F.max("key").alias("last"), F.max("whole").alias("whole"))
                        .where("pivot < last and whole").select("signature", "pivot"), "shared")
        parts.append(stored(signatures.join(shared, "signature").select("signature", "key", "pivot").distinct(), "signatures"))
        release(shared)
    groups = reduce(DataFrame.unionByName, parts)
    release(scanned)

    keys = groups.select("key").distinct()
    nodes = stored(classes.join(keys, "key").select("key", "node"), "nodes")
    docs = docs.where("doc_id is not null")
    repeated = not table.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    sets = sets_of(docs, repeated, nodes, words, "bits")
    # A bitmap has 2 to 4 bits for the 8 bytes of a shingle.
    set_bytes = 32 * (sets.agg(F.avg(F.octet_length("bits")).alias("n")).first()["n"] or 0)

    pairs = stored(groups.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    likely = stored(compared(pairs, sets, "bits", _may_link(percent), "key"), "likely")
    release(pairs)
    links = verified(likely, set_bytes, docs, repeated, nodes, words, percent)
    release(likely)
    components = stored(connected_components(all_of(links, docs.sparkSession)), "components")
    release(*links)
    groups, hits = groups.where("key != pivot").select("signature", "key"), parts
    for everything in (False, True):
        where = nodes.join(components, "node", "left").select("key", F.coalesce("component", "node").alias("part"))
        there = groups.join(where, "key")
        apart = there.groupBy("signature").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("key").alias("pivot"), F.count("*").alias("n"))
        apart = apart.where("lo < hi").select("signature", "pivot", "n")
        groups = stored(there.join(apart, "signature"), "apart")
        release(*hits)
        hits = [groups]
        if groups.isEmpty():
            break
        size = bytes_sent(groups.select("key", tiles().alias("times")), sets, "bits")
        passes = passes_for(size)
        found = [stored(possible_pairs(groups.where(share("signature", k, passes)), sets, percent, everything, size // passes, "pivot"), "found") for k in range(passes)]
        # A pair may be found in several passes.
        likely = stored(all_of(found, docs.sparkSession).where("b is not null").distinct(), "likely")
        # All pairs of the other signatures are among the likely ones.
        left_out = stored(all_of(found, docs.sparkSession).where("b is null").select(F.col("a").alias("signature")), "left_out")
        release(*found)
        links = verified(likely, set_bytes, docs, repeated, nodes, words, percent)
        release(likely)
        if links:
            before = components
            stars = before.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = stored(connected_components(all_of([stars, *links], docs.sparkSession)), "components")
            release(before, *links)
        groups, hits = groups.join(left_out, "signature").select("signature", "key"), [*hits, left_out]
    release(sets, *hits)
    chosen = classes.join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (table.join(chosen, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
