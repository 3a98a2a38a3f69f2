"""Small tables with every odd case, and plain reference results in Python."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, block int, row string, key long, start int, label double, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=1):
    """Copies, near copies, shared passages, periodic and very long texts, nulls, empties, ties, repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 150)
    passage = prose(rng, 70)
    words = base.split()
    texts = [base, base, base + " tail", " ".join(words[:-1] + ["other"]), prose(rng, 40) + " " + passage + "\n" + prose(rng, 30),
             passage + " " + prose(rng, 90), prose(rng, 10) + " " + passage, None, "", " \n\t ", "one", "one two three", "One TWO three", "a " * 300,
             "ab" * 700, "x" * 900, prose(rng, 6000), "é€𝄞 " * 120, "mail a.b@c-d.org, +1 (858) 555-7280; 10.0.0.300 10.1.2.3 4111 1111 1111 1111",
             "same line here\n" * 60, base.upper(), "\n".join([base, base])]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(None, base), (2, texts[2]), (50, passage)]
    return [(i, t, 1, "x", 2, 3, 0.5, -1) for i, t in out]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_substring(data, window=50):
    first = {}
    for i, t in data:
        w = words(t)
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in data:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def plain_bytes(data, window=200):
    count = collections.Counter()
    for i, b in {(i, (t or "").encode()) for i, t in data if i is not None}:
        count.update(b[p : p + window] for p in range(len(b) - window + 1))
    out = []
    for i, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if i is not None and count[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        runs = sum(gone[p] and (p == 0 or not gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[p : p + n]) for p in range(len(w) - n + 1)])


def plain_components(data, percent=85):
    sets = [(i, shingles(t)) for i, t in data]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets:
        for j, y in sets:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(x), None if i is None else root(i)) for i, x in sets]
