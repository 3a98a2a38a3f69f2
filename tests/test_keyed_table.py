"""Idempotent append: replays, touched buckets, concurrent batches, merging."""

import random
import threading
import uuid

import pytest

from attrix.session import ensure_checkpoint_dir
from attrix.sources import keyed
from attrix.sources.keyed import KeyedTable

SCHEMA = "id string, n int, extra double"


@pytest.fixture()
def table(spark):
    return KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}", spark.createDataFrame([], SCHEMA).schema, "id")


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_appends_equal_a_dictionary(spark, table):
    rng, want = random.Random(4), {}
    for _ in range(5):
        new = [(rng.choice([None, *(f"k{rng.randint(0, 40)}" for _ in range(5))]), rng.randint(0, 9), 0.5) for _ in range(30)]
        for r in sorted(new, key=lambda r: (r[0] or "", r[1])):
            want.setdefault(r[0], r)
        before = rows(table.read())
        now = table.append(batch(spark, new))
        assert rows(table.read()) == sorted(want.values(), key=repr)
        assert table.append(batch(spark, new)) == now and rows(table.read()) == sorted(want.values(), key=repr)   # a replay adds nothing
        assert rows(table.read(now - 1)) == before if now else before == []
    assert table.append(batch(spark, new).limit(0)) == now


def test_only_hit_buckets_are_read(spark, table, monkeypatch):
    table.append(batch(spark, [(f"k{i}", i, None) for i in range(300)]))
    read, real = [], KeyedTable._read
    monkeypatch.setattr(KeyedTable, "_read", lambda self, folders, columns, buckets=None: read.append((columns, buckets)) or real(self, folders, columns, buckets))
    table.append(batch(spark, [("k5", 1, None), ("new", 2, None)]))
    assert all(columns == ["id"] and len(buckets) <= 2 for columns, buckets in read) and read
    assert len(rows(table.read())) == 301


def test_batches_at_the_same_time(spark, table):
    def add(k):
        table.append(batch(spark, [("same", k, None), (f"own{k}", k, None)]))
    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r[0] for r in rows(table.read())) == ["own0", "own1", "own2", "own3", "same"]


def test_merging_keeps_rows(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "MERGE", 2)
    for k in range(4):
        table.append(batch(spark, [(f"k{k}", k, 1.0)]))
    assert [r[0] for r in rows(table.read())] == ["k0", "k1", "k2", "k3"]
    assert len(table._folders(table.log.latest())) <= 2
