"""Cases that once gave partial or wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from attrix.operators import recommend as I
from attrix.operators.neighbors import knn, smote
from attrix.operators.stats import quantiles
from attrix.sources.files import read_csv
from attrix.streaming import jobs as M


def test_quantiles_are_exact_with_hot_values_and_nulls(spark):
    import random
    rng = random.Random(1)
    xs = [rng.choice([0.0, 5.0, rng.gauss(0, 3)]) for _ in range(3000)]
    rows = [(x, None if i % 3 else float(i), None) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["a", "b", "c"], probs)
    arr = F.array(*map(F.lit, probs))
    want = df.agg(F.percentile("a", arr).alias("a"), F.percentile("b", arr).alias("b")).first()
    assert got["c"][0] is None
    for c in "ab":
        assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got[c][0], want[c]))


def test_a_stream_limit_fails_instead_of_stopping_early(spark, tmp_path):
    src = M.stage_source(spark.range(2000).repartition(40), "limit")
    s = M.file_stream(spark, src, spark.range(1).schema, files_per_trigger=1)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(TimeoutError):
        M.run(q, limit_s=0.2)


@pytest.mark.parametrize("files", [1, 4])
def test_ttl_dedupe_does_not_depend_on_batches(spark, tmp_path, files):
    rows = [(u, 1_700_000_000 + 300 * i * (u + 1)) for u in range(3) for i in range(60)] + [(7, 1_700_000_000), (7, 1_700_001_800), (7, 1_700_001_801)]
    df = spark.createDataFrame(rows, "u long, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    src = str(tmp_path / "in")
    bounds = [1_700_000_000 + 20_000 * i for i in range(4)] + [1 << 40]
    for lo, hi in zip(bounds, bounds[1:]):   # files in event-time order
        df.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi)).coalesce(1).write.mode("append").parquet(src)
    M.run(M.dedupe_within_ttl(M.file_stream(spark, src, df.schema, files), "u", "ts", 1800, str(tmp_path / "o"), str(tmp_path / "c")))
    got = sorted((r["u"], r["s"]) for r in spark.read.parquet(str(tmp_path / "o")).select("u", F.unix_seconds("ts").alias("s")).collect())
    want, last = [], {}
    for u, s in sorted(rows, key=lambda r: r[1]):
        if u not in last or s - last[u] > 1800:
            want.append((u, s))
            last[u] = s
    assert got == sorted(want)


def test_ttl_dedupe_of_a_hot_key_needs_bounded_memory():
    import random
    import tracemalloc

    import numpy as np
    import pandas as pd
    rng = random.Random(6)
    for rows in (1, 3, 100):
        for last in (None, 40):
            times = [rng.randint(0, 2000) for _ in range(300)]
            want, seen = [], last
            for t in sorted(times):
                if seen is None or t - seen > 7:
                    want.append(t)
                    seen = t
            frames = (pd.DataFrame({"us": times[i : i + 40]}) for i in range(0, 300, 40))
            assert np.concatenate(list(M.kept_times(frames, last, 7, rows))).tolist() == want
    n = 2_000_000
    shuffled = (pd.DataFrame({"us": (np.arange(i, i + 10_000, dtype="int64") * 7_654_321) % n}) for i in range(0, n, 10_000))
    tracemalloc.start()
    kept = np.concatenate(list(M.kept_times(shuffled, None, 1800, 100_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept.tolist() == list(range(0, n, 1801)) and peak < 8 << 20


def test_ttl_dedupe_of_a_hot_key_in_one_batch(spark, tmp_path):
    n = M.RUN_ROWS + 400_000
    df = spark.range(n).select(F.when(F.col("id") % 100_000 == 1, 2).otherwise(1).cast("long").alias("u"), F.timestamp_seconds((F.col("id") * 7_654_321) % n + 1_700_000_000).alias("ts"))
    src = M.stage_source(df, "hot")
    M.run(M.dedupe_within_ttl(M.file_stream(spark, src, df.schema), "u", "ts", 1800, str(tmp_path / "o"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "o")).groupBy("u").agg(F.sort_array(F.collect_list(F.unix_seconds("ts") - 1_700_000_000)).alias("s")).collect()
    rare = sorted(i * 7_654_321 % n for i in range(1, n, 100_000))
    for user in got:
        want, last = [], None
        for t in rare if user["u"] == 2 else (t for t in range(n) if t not in rare):
            if last is None or t - last > 1800:
                want.append(t)
                last = t
        assert user["s"] == want
    assert len(got) == 2


def test_knn_refuses_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, a double")
    with pytest.raises(ValueError):
        knn(df, df, ["a"], 1, "id", "id")


def test_smote_with_fewer_neighbours_than_k(spark):
    rows = [(i, float(i), 0) for i in range(20)] + [(100 + i, 50.0 + i, 1) for i in range(3)]
    out = smote(spark.createDataFrame(rows, "id long, a double, y int"), "y", "id", ["a"], k=5)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 20, 1: 20}
    assert out.where("a is null").count() == 0


def test_training_with_smote(spark):
    from pyspark.ml.classification import LogisticRegression

    from attrix.operators.train import train_and_select
    rows = [(i, float(i % 17), "xyz"[i % 3], int(i % 17 > 12)) for i in range(170)]
    df = spark.createDataFrame(rows, "id long, a double, c string, y int")
    result = train_and_select(df, "y", "id", ["id"], [], models={"lr": LogisticRegression(maxIter=20)}, balance="smote")
    assert result.best_name == "lr" and result.leaderboard.first()["test_roc_auc"] > 0.9


def test_one_bad_element_does_not_lose_a_reply(spark):
    replies = ['[{"action":"x"},"oops"]', '```json\n[{"action":"y","impact":"35.7","priority":"haute"}]\n```', "no json", "[]", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = {r["i"]: r["v"] for r in df.select("i", I.validate_actions(I.parse_replies("reply")).alias("v")).collect()}
    assert [a["action"] for a in got[0]] == ["x"] and [(a["action"], a["impact"], a["priority"]) for a in got[1]] == [("y", 20, "Haute")]
    assert got[2] is None and got[3] is None and got[4] is None


def test_csv_keeps_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    assert sorted((r["a"], r["b"]) for r in read_csv(spark, str(path)).collect()) == [(1, "x\ny"), (2, "z")]


def test_text_targets_and_bad_targets(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL

    from attrix.operators.clean import encode_target
    df = spark.createDataFrame([("Yes", 1), ("No", 2), (None, 3), ("Yes", 1)], "t string, n int")
    out, classes = encode_target(df, "t")
    assert classes == ["No", "Yes"] and [r["label"] for r in out.collect()] == [1, 0, None, 1]
    for bad in (df.limit(0), df.where("t = 'Yes'")):
        with pytest.raises(ValueError):
            encode_target(bad, "t")
    with pytest.raises(ValueError, match="more"):
        encode_target(df, "n")
    levels = {r["level"]: r["left_share"] for r in entry.queries()["trained_scores"](spark, SF_SMALL).collect()}
    assert levels.get("eleve", 1.0) > levels.get("faible", 0.0)


def test_blank_documents_are_left_out(spark, tmp_path):
    from attrix.sources.files import read_documents
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "# T\n\nwords"), ("b.txt", " \n\t \n"), ("in/c.markdown", ""), ("in/d.txt", "\n x \n"), ("e.csv", "no")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert sorted(r["text"] for r in read_documents(spark, str(tmp_path)).collect()) == ["\n x \n", "# T\n\nwords"]


def test_written_documents_lie_in_shards_one_file_per_id(spark, tmp_path):
    from attrix.sources import files

    rows = [(i, f"text {i}\nof two lines") for i in range(300)] + [(7, "once more"), (None, "no id")]
    root = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), root, "doc_id")
    # Folders are moved and listed one by one at the top; there are as many as shards, not as documents.
    assert len([p for p in (tmp_path / "docs").iterdir() if p.is_dir()]) <= 8
    assert len(list((tmp_path / "docs").rglob("*.txt"))) == 301
    back = {}
    for r in files.read_documents(spark, root).collect():
        back.setdefault(r["source"].split("doc_id=")[1].split("/")[0], []).append(sorted(r["text"].strip("\0").split("\0")))
    expected = {}
    for i, t in rows:
        expected.setdefault("__HIVE_DEFAULT_PARTITION__" if i is None else str(i), []).append(t)
    assert back == {k: [sorted(v)] for k, v in expected.items()}


def test_documents_of_a_mounted_folder_are_written_and_read_by_tasks(spark, tmp_path):
    from attrix.sources import files

    rows = [("a b", "x"), ("100%", "y"), ("p[1]#{}", "z"), ("é/=", "w\nw"), ("", "no name"), (None, None), ("a b", "again")]
    docs = spark.createDataFrame(rows, "id string, text string")
    root = str(tmp_path / "docs")
    files.write_documents(docs, root, "id")
    names = lambda top: {p.name for p in top.rglob("id=*")}
    docs.withColumn("shard", F.lit(0)).coalesce(1).write.partitionBy("shard", "id").option("lineSep", "\0").text(str(tmp_path / "sparks"))
    assert names(tmp_path / "docs") == names(tmp_path / "sparks")
    # No file has a companion from Spark's writer, nothing is left of the attempts, and an existing folder is refused.
    assert {p.name for p in (tmp_path / "docs").rglob("*") if p.is_file()} == {"part-00000.txt", "_SUCCESS"}
    assert not (tmp_path / "docs/_temporary").exists()
    with pytest.raises(FileExistsError):
        files.write_documents(docs, root, "id")
    # The same names and texts as from Spark's scan.
    for name in ("_x/a.md", "_y=1/a.md", ".z.md", "in/1 2.md", "in/é#%.txt", "in/more/f.markdown", "in/g.csv", "h._COPYING_", "B.MD"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_bytes(b"text \xff " + name.encode())
    sparks = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt,markdown}")
    expected = sorted(map(tuple, sparks.select("_metadata.file_path", F.md5("value")).collect()))
    df = files.read_documents(spark, root)
    assert len(df.inputFiles()) == 0   # no list of files on the driver
    assert sorted(map(tuple, df.select("source", F.md5("text")).collect())) == expected and len(expected) == 10
