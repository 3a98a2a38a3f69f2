"""Resampling, conversation repair and URL filters against plain Python."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_cases as cases  # noqa: E402

from attrix.llm import conversation_repair as repair  # noqa: E402
from attrix.llm import importance_resampling as resampling  # noqa: E402
from attrix.llm import url_filter as urls  # noqa: E402
from attrix.llm.queries import URL_RULES  # noqa: E402
from attrix.llm.re_pair import re_pair  # noqa: E402


# Resampling.

def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[p : p + n]) for n in (1, 2, 3) for p in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t))
    t = Counter(bucket(f) for x in target for f in plain_features(x))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (s.total() + 10000.0)) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    out = []
    for i, text in docs:
        f = plain_features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(plain_words(text)), len(f), weight, score, None])
    can = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_hashes_run_over_slices(size):
    for _, text, *_ in cases.rows():
        found = Counter(h for _, hs in resampling.hashes((text or "").encode(), 3, size) for h in hs)
        assert found == Counter(zlib.crc32(f.encode()) for f in plain_features(text))
        assert sum(n for n, _ in resampling.hashes((text or "").encode(), 3, size)) == len(plain_words(text))


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample_equals_plain(spark, percent):
    data = cases.rows()
    target = ["abc def gh", None, "", cases.prose(random.Random(5), 40), "É é ünd 9_9 A-Z"]
    got = resampling.resample(cases.table(spark, data).drop("n_chars"), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample([r[:2] for r in data], target, percent)


def test_equal_ids_get_ranks_of_their_own(spark):
    data = [(1, "one two " * 15)] * 40 + [(k, f"w{k} " * 30) for k in range(2, 30)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = resampling.resample(docs, docs.limit(0), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 35)) and len(got) == 68
    assert resampling.resample(docs.limit(0), docs, 50).collect() == []


# Conversation repair.

def every_audit(rows):
    """The cheapest, then least audit by trying all edits: (cost, audit, repaired rows)."""
    found = []
    gaps = [list(itertools.product(("user", "assistant"), repeat=n)) for n in range(3)]
    inserts = [x for g in gaps for x in g]
    for before in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, before)) > 4:
            continue
        for done in itertools.product("KuaD", repeat=len(rows)):
            cost = audit = 0
            cost, audit, out = 3 * sum(map(len, before)), "", []
            for (role, text, fault), e, new in zip(rows, done, before):
                audit += "I" * len(new)
                out += [(r, "") for r in new]
                if e != "D" and fault in (1, 2):
                    break
                audit += "R" if e in "ua" else e
                cost += 4 if e == "D" else (3 if e in "ua" else 0) + 3 * (fault == 3)
                out += [] if e == "D" else [({"u": "user", "a": "assistant"}.get(e, role), text)]
            else:
                audit += "I" * len(before[-1])
                out += [(r, "") for r in before[-1]]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    found.append((cost, audit, out))
    return min(found)


def best(rows):
    symbols = [repair.symbol(repair.initial(r), f) for r, _, f in rows]
    matrix = repair.sequence_matrices([tuple(symbols)])[0] if rows else {(0, 0): (0, repair.leaf(""))}
    ends = [v for (i, j), v in repair.product(matrix, repair.insertions()).items() if i == 0 and j in (0, 3)]
    return min((cost, repair.flat(audit)) for cost, audit in ends)


def test_least_audits_equal_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{k}.", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randint(1, 3))]
        cost, audit, out = every_audit(rows)
        assert best(rows) == (cost, audit)
        kinds = "".join(repair.initial(r) for r, *_ in rows)
        got = [(role or rows[at][0], "" if e == "I" else rows[at][1]) for e, at, role in repair.edits(audit, 0, kinds) if e != "D"]
        assert got == out


def plain_repair(rows):
    """State by state with plain strings: (cost, audit) of rows (role, text, fault), any number of them."""
    state = {0: (0, "")}
    to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def opened(now):
        now = dict(now)
        for _ in range(3):
            for i, (c, a) in list(now.items()):
                j = 3 if i == 2 else 2
                now[j] = min(now.get(j, (1 << 60, "")), (c + 3, a + "I"))
        return now

    for role, _, fault in rows:
        new = {}
        for i, (c, a) in opened(state).items():
            ways = [(i, 4, "D")]
            if fault not in (1, 2):
                late = 3 * (fault == 3)
                ways += [(to[x][i], 3 + late, "R") for x in "ua" if i in to[x]]
                ways += [(to[role[:1]][i], late, "K")] if role[:1] in to and i in to[role[:1]] else []
            for j, cost, letter in ways:
                new[j] = min(new.get(j, (1 << 60, "")), (c + cost, a + letter))
        state = new
    return min(v for k, v in opened(state).items() if k in (0, 3))


def test_grammar_gives_the_plain_answer():
    rng = random.Random(4)
    many = [[(rng.choice(["system", "user", "assistant", "x"]), "", rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 60))] for _ in range(200)]
    many += [[("user", "", 0)] * 300, [("user", "", 3), ("assistant", "", 0)] * 200, [("system", "", 0)] * 50, [("user", "", 2)] * 99]
    symbols = [tuple(repair.symbol(repair.initial(r), f) for r, _, f in rows) for rows in many]
    for rows, matrix in zip(many, repair.sequence_matrices(symbols)):
        ends = [v for (i, j), v in repair.product(matrix, repair.insertions()).items() if i == 0 and j in (0, 3)]
        assert min((cost, repair.flat(audit)) for cost, audit in ends) == plain_repair(rows)


def test_grammar_expands_to_its_sequences():
    rng = random.Random(1)
    for t in range(100):
        sequences = [[rng.choice((0, 1, 2)) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(0, 6))] + [[1] * t]
        rules, short = re_pair(sequences, 3)
        full = lambda x: [x] if x < 3 else full(rules[x - 3][0]) + full(rules[x - 3][1])
        assert [[y for x in s for y in full(x)] for s in short] == sequences


def plain_report(rows):
    """repair_report by sorted lists; rows are (conv_id, turn, role, text)."""
    out = []
    blank = lambda x: " " if x is None else x
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = blank(role), blank(text)
            kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for turn, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            judged.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        cost, audit = plain_repair(judged) if judged else (0, "")
        kinds = "".join(repair.initial(r) for r, *_ in judged)
        lines = [f"{role or judged[at][0]}:{'' if e == 'I' else judged[at][1]}" for e, at, role in repair.edits(audit, 0, kinds) if e != "D"]
        n = Counter(f for *_, f in judged)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n[1], n[2], n[3], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(9)
    text = lambda: rng.choice(["Hello there.", "Why?", "cut off", "", " \n", None, "é!", "x" * 3000 + ".", "same.", "same."])
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text()) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "ua"[t % 2] + "x", f"turn {t}.") for t in range(900)]  # spread over pieces and partitions
    rows += [(51, None, "user", "hi."), (51, 3, "user", "hi."), (51, 3, "user", "hi."), (51, 3, "assistant", "yes."), (51, -5, "system", "s.")]
    rows += [(None, t, "user", "null id.") for t in (0, 1, 1, None)] + [(52, 1, "user", "again.")] * 300 + [(53, t, "user", "again.") for t in range(200)]
    rows += [(c, 7, "user", "one.") for c in range(60, 120)]
    return rows


def test_report_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 64)
    monkeypatch.setattr(repair, "BATCH_SYMBOLS", 200)
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, row string, marked int").repartition(5)
    got = repair.repair_report(table)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_report(rows)
    assert repair.repair_report(table.limit(0)).collect() == []


def test_text_ids_and_real_rows(spark):
    table = spark.createDataFrame([("a", 0, "user", "Q?"), ("a", 1, "user", "more"), ("a", 2, "assistant", "A."), ("b", 0, "assistant", "A.")],
                                  "conv_id string, turn int, role string, text string")
    conversations, rows = repair.repair(table)
    assert [tuple(r) for r in conversations.orderBy("conv_id").collect()] == [("a", 0, 0, 0, 1, 1, 4, "KDK"), ("b", 0, 0, 0, 0, 0, 3, "IK")]
    got = rows.orderBy("conv_id", "part", "chunk", "item").select("conv_id", "edit", "turn", "role", "text").collect()
    assert [tuple(r) for r in got] == [("a", "K", 0, "user", "Q?"), ("a", "K", 2, "assistant", "A."), ("b", "I", None, "user", ""), ("b", "K", 0, "assistant", "A.")]


# URL filter.

def plain_verdict(url):
    host = path = ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split("[?#]", rest[cut:])[0]
    fits = [(len(r), r, v) for v, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    from urllib.parse import unquote
    text = unquote(url or "").lower()
    found = lambda t: re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text)
    weight = sum(w for t, w in urls.VOCABULARY.items() if found(t))
    return host, path, None, "block" if weight >= urls.LIMIT else "allow"


URLS = ["https://a.Example.net/en/1?x=1", "https://a.example.net/fr/", "http://net", "http://net/", "http://xnet/", "ftp://EXAMPLE.com/de/", "http://example.com/de", None, "",
        "no scheme", "http://h.org/fr/x", "http://h.org/fr", "https://spam-farm.example.com/a", "https://x.com/free/deals", "https://x.com/free/free/", "https://x.com/adulthood",
        "https://x.com/%63asino", "https://x.com/a?b=://net/", "mailto:a@net/", "https://user@net:80/x", "://net/x", "https://x.com/" + "free-" * 30000, "http://" + "a." * 50000 + "net/",
        "http://x.com/casinoé", "http://x.com/casino_1", "HTTP://X.COM/PORN", "http://a.b\n.net/\n/en/", "http://.net/", "http://net./", "http://x.com/cheap%2Dpills"]


def test_urls_equal_plain(spark):
    data = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[0]), (3, URLS[3])]
    table = spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, host string, verdict string").repartition(3)
    got = urls.url_filter(table, URL_RULES).drop("terms").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain_verdict(u)) for i, u in data), key=repr)
    assert urls.url_filter(table.limit(0), URL_RULES).collect() == []


def test_terms_and_rules():
    words = urls.Vocabulary({"free": 1, "win": 1, "casino": 2}, 2)
    assert [words.verdict(u) for u in ("x/free/free", "x/free-win", "x/casino", "x/casinos", "x/wins/free", "")] == ["allow", "block", "block", "allow", "allow", "allow"]
    rules = urls.Rules([("allow", "a.org/"), ("block", "a.org/x/"), ("block", "org/"), ("allow", "a.org/x/")])
    assert rules.longest("b.a.org", "/x/1") == ("a.org/x/", "block") and rules.longest("b.a.org", "/y") == ("a.org/", "allow")
    assert rules.longest("c.org", "/x/1") == ("org/", "block") and rules.longest("ba.org", "") == (None, None)
    with pytest.raises(ValueError):
        urls.Rules([("maybe", "a/")])
    with pytest.raises(ValueError):
        urls.Vocabulary({"": 1}, 2)


def test_given_pages_are_judged_both_ways(spark):
    from attrix.llm.queries import QUERIES
    got = QUERIES["op13_url_filter"](spark, "/root/testdata/sf0.01")
    n = {r["k"]: r["n"] for r in got.groupBy(F.concat_ws(" ", F.col("rule").isNull(), "verdict").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert n.keys() == {"true allow", "true block", "false allow", "false block"}
