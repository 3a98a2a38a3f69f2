"""Deduplication operators against plain Python."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_cases as cases  # noqa: E402

from attrix.llm import column_bwt_dedup as bwt  # noqa: E402
from attrix.llm import shingle_join as join  # noqa: E402
from attrix.llm import substring_dedup as sub  # noqa: E402
from attrix.llm.components import connected_components  # noqa: E402
from attrix.llm.embedding_dedup import embedding_dedup, linked_pairs, quantised  # noqa: E402


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def data():
    return cases.rows()


def test_substring_dedup_matches_plain_python(spark, data):
    got = sub.substring_dedup(cases.table(spark, data), with_text=False).collect()
    assert ordered(got) == ordered(cases.plain_substring([r[:2] for r in data]))


def test_substring_dedup_keeps_the_other_columns_and_untouched_texts(spark, data):
    got = sub.substring_dedup(cases.table(spark, data)).collect()
    texts = {(r[0], r[1]) for r in data}
    assert all(r["row"]["key"] == 2 and (r["row"]["doc_id"], r["row"]["text"]) in texts for r in got)
    assert all(r["kept"] == r["row"]["text"] for r in got if not r["n_removed"])
    assert all(cases.sha(r["kept"]) == r["kept_sha256"] for r in got if r["n_removed"])


def test_phrase_automaton_finds_every_occurrence():
    rng = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(2000)]
    words = [rng.choice(vocabulary[:40]) for _ in range(3000)]
    phrases = [b" ".join(words[p : p + 4]) for p in rng.sample(range(2900), 300)] + [b" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(500)]
    machine = sub.Phrases(sorted(set(phrases)), 4)
    found = set(machine.ends(sub.words_of(b" ".join(words))[0]).tolist())
    assert found == {p + 3 for p in range(len(words) - 3) if b" ".join(words[p : p + 4]) in set(phrases)}


@pytest.mark.parametrize("hot", [bwt.HOT, 1])
def test_column_bwt_matches_plain_python(spark, data, hot):
    got = bwt.column_bwt_dedup(cases.table(spark, data), hot=hot, with_text=False).collect()
    assert ordered(got) == ordered(cases.plain_bytes([r[:2] for r in data]))


def test_columns_find_repeated_windows():
    rng = random.Random(5)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(12, 30))).encode() for _ in range(60)]
    group, lead = np.sort(np.array([rng.randint(0, 3) for _ in pieces])), np.array([rng.randint(0, 5) for _ in pieces])
    mask = bwt.repeated_columns(group, lead, pieces, 8)
    for i, x in enumerate(pieces):
        for o in range(len(x) - 7):
            other = any(j != i and group[j] == group[i] and 0 <= (p := o - lead[i] + lead[j]) and pieces[j][p : p + 8] == x[o : o + 8] for j in range(len(pieces)))
            assert mask[i, o] == other


def test_shingle_join_matches_plain_python(spark, data):
    got = join.shingle_join(cases.table(spark, data)).collect()
    assert ordered(got) == ordered(cases.plain_components([r[:2] for r in data]))


def near_copies(n, seed):
    """Chains and clusters around the threshold, many of them not linked directly."""
    rng = random.Random(seed)
    out = []
    for c in range(4):
        base = cases.prose(rng, rng.randint(20, 160)).split()
        for i in range(n):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(1000)
            out.append((c * 1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("tile", [join.TILE, 3])
def test_no_link_is_lost_in_crowded_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(join, "TILE", tile)
    data = near_copies(25, 11)
    got = join.shingle_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(cases.plain_components(data))


@pytest.mark.parametrize("documents", [1, 10**12])
def test_similar_sets_share_a_signature(documents):
    rng = np.random.default_rng(2)
    for size in (*range(1, 40), 60, 90, 141, 142, 300, 1500):
        for _ in range(6):
            x = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            keep = rng.permutation(len(x))
            drop = int(rng.integers(0, len(x) * 15 // 100 + 1))
            y = x[np.sort(keep[drop:])]
            add = int(rng.integers(0, max(0, int((len(y) * 100 / 85)) - len(x)) + 1))
            y = np.unique(np.concatenate([y, rng.integers(1 << 62, 1 << 63, add).astype(np.uint64)]))
            if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
                continue
            bands = join.Bands(85, documents)
            one, two = ({(b.low, int(s)): f for b in bands.of(len(z)) for s, f in zip(*b.signatures(z))} for z in (x, y))
            assert any(one[k] or two[k] for k in one.keys() & two.keys())
            p, q = join.parity_bits(x), join.parity_bits(y)
            n = min(len(p), len(q))
            assert np.bitwise_count(join.folded(p, n) ^ join.folded(q, n)).sum() <= len(np.setxor1d(x, y))


def test_bitmaps_are_short_and_whole_sets_come_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for size in (64, 65, 300, 1500):
        assert 64 * len(join.parity_bits(np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64)))) <= 4 * size
    words = [f"w{k}" for k in rng.integers(0, 100_000, 200 * 60)]
    # Every other text is a near copy of the one before; the others share four words with all.
    texts = [" ".join(["all", "of", "them", "say"] + words[200 * (i // 2) : 200 * (i // 2) + 200 - i % 2]) if i < 40 else
             " ".join(["all", "of", "them", "say"] + words[200 * i : 200 * i + 3]) for i in range(60)]
    seen, keep = {}, join.stored

    def counted(df, name):
        out = keep(df, name)
        seen[name] = seen.get(name, []) + [out.count()]
        return out
    monkeypatch.setattr(join, "stored", counted)
    got = {r["doc_id"]: r["component_id"] for r in join.shingle_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < 40 else i for i in range(60)}
    assert len(seen["signatures"]) == join.PASSES and sum(seen["shingles"]) == 40


def test_groups_are_sized_for_the_payloads_sent_to_them(spark, monkeypatch):
    n, limit = 1000, 100_000
    for name, value in (("TILE", 20), ("PARTNERS", 10), ("GROUP_BYTES", limit)):
        monkeypatch.setattr(join, name, value)

    def total(table, column="bits"):
        return pa.table({"a": [sum(map(len, table.column(column).to_pylist()))], "b": [0]})

    monkeypatch.setattr(join, "_tile_pairs", lambda percent, everything: lambda table: total(table))
    monkeypatch.setattr(join, "_compare", lambda test, result: lambda left, right: total(pa.concat_tables([left, right]), "payload"))
    sets = spark.range(n).select(F.col("id").alias("key"), F.col("id").alias("node"), F.repeat(F.lit("x"), 500).cast("binary").alias("bits")).cache()
    groups = spark.range(n).select(F.lit(1).cast("long").alias("signature"), F.col("id").alias("key"), F.col("id").alias("part"), F.lit(n).cast("long").alias("n"))
    assert max(r["a"] for r in join.possible_pairs(groups, sets, 80, False).collect()) <= 4 * limit
    pairs = spark.range(300 * 200).selectExpr("id % 300 as a", "300 + id div 300 as b")
    assert max(r["a"] for r in join.compared(pairs, sets, "bits", None, "key").collect()) <= 4 * limit


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(500, 400 + i) for i in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 32)), rng.normal(size=(300, 32)) * 50
    y[:100] = x[:100] * 3 + rng.normal(size=(100, 32)) * 0.1
    (cx, sx, ex), (cy, sy, ey) = quantised(x), quantised(y)
    exact = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
    product = (cx.astype(float) @ cy.T.astype(float)) * sx[:, None] * sy[None, :]
    assert (np.abs(exact - product) <= ey[None, :] + ex[:, None] * (1 + ey[None, :])).all()
    a, b = linked_pairs(x, y, 0.98, False)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, np.nonzero(exact >= 0.98))))


def test_embedding_dedup_matches_plain_python(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.normal(size=8) * (0.0 if i % 10 == 0 else 0.12)
        rows.append((i, v.tolist(), i % 2, "a"))
    rows += [(200, None, 1, "a"), (201, [0.0] * 8, 1, "a"), (202, [float("nan")] * 8, 1, "a"), (203, [None, 1.0], 1, "a"), (204, rows[0][1], None, "a"),
             (205, [], 0, "a"), (None, rows[0][1], 0, "a"), (3, rows[3][1], 1, "a"), (206, [2.0, 1.0], 0, "a"), (207, [4.0, 2.0], 0, "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    linked = {}
    good = {(r[0], r[2], tuple(r[1])) for r in rows if r[0] is not None and r[2] is not None and r[1] and all(a is not None and a == a for a in r[1]) and any(r[1])}
    for i, l, v in good:
        for j, m, w in good:
            if i != j and l == m and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w)) >= 0.98:
                linked.setdefault(i, set()).add(j)

    def reach(i):
        seen, todo = {i}, [i]
        for x in todo:
            new = linked.get(x, set()) - seen
            seen |= new
            todo += new
        return min(seen)

    expected = [(i, len(linked.get(i, ())) if i is not None and (i, r[2], tuple(r[1] or ())) in good else 0, None if i is None else reach(i), i is not None and reach(i) == i) for r in rows for i in r[:1]]
    for tile in (2048, 16):
        assert ordered(embedding_dedup(frame, tile=tile).collect()) == ordered(expected)


@pytest.mark.parametrize("call", [sub.substring_dedup, bwt.column_bwt_dedup, join.shingle_join])
def test_empty_tables(spark, call):
    assert call(spark.createDataFrame([], cases.SCHEMA)).count() == 0


def test_empty_embeddings(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_small_tables_need_one_pass_and_stars_no_round(spark, monkeypatch):
    from attrix.llm import components

    seen = {}

    def counting(module):
        keep = module.stored

        def counted(df, name):
            seen[name] = seen.get(name, 0) + 1
            return keep(df, name)
        monkeypatch.setattr(module, "stored", counted)
    counting(join)
    counting(components)
    data = near_copies(25, 11)
    got = join.shingle_join(spark.createDataFrame(data, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(cases.plain_components(data))
    # Whole sets are made once for the stars and once for each way of taking up signatures again, not once per pass.
    assert seen["signatures"] == join.PASSES and seen["shingles"] <= 3 and seen["found"] <= 2
    seen.clear()
    stars = spark.createDataFrame([(k % 3, 10 + k) for k in range(50)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(stars).collect()} == {k % 3: k % 3 for k in range(3)} | {10 + k: k % 3 for k in range(50)}
    assert seen == {"edges": 1}


def test_passes_over_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(join, "PASS_BYTES", 1)
    data = near_copies(25, 11)
    got = join.shingle_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(cases.plain_components(data))


def test_second_look_at_tiles_takes_what_the_first_left_out(spark, monkeypatch):
    # Two clusters and texts that collide on a few words; most signatures are done after the first look.
    rng = random.Random(8)
    data = near_copies(25, 12) + [(9000 + i, "so it goes on " + cases.prose(rng, 30)) for i in range(40)]
    seen, pairs = [], join.possible_pairs

    def counted(groups, sets, percent, everything, *rest):
        out = pairs(groups, sets, percent, everything, *rest)
        seen.append((everything, groups.select("signature").distinct().count(), out.where("b is null").count()))
        return out
    monkeypatch.setattr(join, "possible_pairs", counted)
    got = join.shingle_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(cases.plain_components(data))
    first, second = [x for x in seen if not x[0]], [x for x in seen if x[0]]
    assert first and sum(x[1] for x in second) <= sum(x[2] for x in first) < sum(x[1] for x in first)
    assert not any(x[2] for x in second)


def test_pairs_of_many_signatures_are_found_once_a_group(spark, monkeypatch):
    # 30 nodes share 50 signatures; all bitmaps are alike but for a bit or two.
    nodes, bits = range(30), [(40).to_bytes(8, "little") + bytes([1 << i % 8, i // 8] + [0] * 14) for i in range(30)]
    sets = spark.createDataFrame([(k, k, bits[k]) for k in nodes], "key long, node long, bits binary")
    groups = spark.createDataFrame([(s, k, k, 0, 30) for s in range(50) for k in nodes], "signature long, key long, part long, pivot long, n long")
    assert join.dealt_tiles(groups, sets, None, "pivot").select("g").distinct().count() == 1
    found = join.possible_pairs(groups, sets, 80, True, None, "pivot")
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, j) for i in nodes for j in range(i + 1, 30)}
    # What is more than a group holds is split.
    monkeypatch.setattr(join, "GROUP_BYTES", 24 * 30 * 10)
    assert 2 <= join.dealt_tiles(groups, sets, None, "pivot").select("g").distinct().count() <= 5
