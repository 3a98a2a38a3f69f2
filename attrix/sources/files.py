"""File sources and sinks.

Readers sniff what the reference sniffs - encoding, separator, header blanks -
with small Spark jobs over the file itself (a count of undecodable lines, the
first line), never by pulling the file through the driver. Written tables go to
the shared folder named by ``spark.checkpoint.dir`` (see ``scratch_path``).
"""

from __future__ import annotations

import datetime as _dt
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, settings, shuffles_freed
from .tables import nan_to_null

# Accepted extensions per reader.
CSV_EXT = (".csv", ".txt")
PARQUET_EXT = (".parquet", ".pq")
DOC_EXT = ("md", "txt", "markdown")
SEPARATORS = (",", ";", "\t", "|")
#: Files in a shard folder of written documents, about.
SHARD_FILES = 1000
#: Texts in a batch sent to the task that writes them, and bytes of texts in a batch that comes from a scan.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

# Windows-1252 characters of the bytes 0x80-0x9F (0x81, 0x8D, 0x8F,
# 0x90 and 0x9D are undefined and stay as they are).
CP1252_C1_FROM = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_C1_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def scratch_path(spark: SparkSession, name: str = "io") -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/attrix-{name}/{uuid.uuid4().hex}"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """A4: UTF-8 unless some line is not valid UTF-8, then ISO-8859-1 (one filtered scan)."""
    bad = (spark.read.text(path).where(~F.expr("is_valid_utf8(value)")).limit(1).count())
    return "ISO-8859-1" if bad else "UTF-8"


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """A5: most frequent of ``, ; TAB |`` in the first line (comma on ties/none)."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    counts = [(line.count(s), -i, s) for i, s in enumerate(SEPARATORS)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip a BOM and surrounding blanks from column names."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def fix_cp1252(df: DataFrame) -> DataFrame:
    """After an ISO-8859-1 read, map the C1 control range to the Windows-1252 characters."""
    exprs = [F.translate(F.col(f"`{f.name}`"), CP1252_C1_FROM, CP1252_C1_TO).alias(f.name)
             if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*exprs)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             infer: bool = True, multi_line: bool = True) -> DataFrame:
    """A1 + A4-A6: header row, inferred types, sniffed separator and encoding.

    Quoted fields may hold line breaks, so a file is read by one task; ``multi_line=False`` lets Spark split files
    that are known to have a record per line.
    """
    enc = encoding or detect_encoding(spark, path)
    sep = sep or sniff_separator(spark, path, enc)
    df = (spark.read.option("header", True).option("inferSchema", infer).option("sep", sep)
          .option("encoding", enc).option("multiLine", multi_line).csv(path))
    df = clean_headers(df)
    if enc.upper() in ("ISO-8859-1", "LATIN1"):
        df = fix_cp1252(df)
    return nan_to_null(df)


def read_dataset(spark: SparkSession, path: str, **kw) -> DataFrame:
    """A3: dispatch on the extension; missing path -> FileNotFoundError; unknown -> ValueError."""
    base = path.rstrip("/")
    ext = os.path.splitext(base)[1].lower()
    if ext not in CSV_EXT + PARQUET_EXT:
        raise ValueError(f"unsupported format '{ext}'; accepted: {', '.join(CSV_EXT + PARQUET_EXT)}")
    if not _exists(spark, base):
        raise FileNotFoundError(base)
    if ext in PARQUET_EXT:
        return nan_to_null(clean_headers(spark.read.parquet(base)))    # A2
    return read_csv(spark, base, **kw)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def land_dataset(df: DataFrame, root: str, dataset: str) -> str:
    """Land a dataset as a new parquet version; never overwrite (timestamped name)."""
    version = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "_" + uuid.uuid4().hex[:6]
    path = f"{root.rstrip('/')}/dataset={dataset}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_profile(profile_df: DataFrame, path: str) -> None:
    """schema/profile sink (JSON lines)."""
    profile_df.coalesce(1).write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Schema scan with an explicit schema; None when absent."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(schema).json(path)


def write_reference(reference: DataFrame, path: str) -> None:
    """A10: drift reference sink."""
    reference.write.mode("overwrite").parquet(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """A10: drift reference scan, tolerant of absence."""
    return spark.read.parquet(path) if _exists(spark, path) else None


def list_datasets(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Landed dataset folders with their modification time (file-system listing only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return []
    out = []
    for ds in fs.listStatus(base):
        if ds.isDirectory():
            for v in fs.listStatus(ds.getPath()):
                if v.isDirectory():
                    out.append((v.getPath().toString(), v.getModificationTime()))
    return out


def newest_dataset(spark: SparkSession, root: str, features: list[str] | None = None) -> str | None:
    """Newest landed dataset holding every model feature, else the newest one.

    Only schemas are read (parquet footers), not the data."""
    cands = sorted(list_datasets(spark, root), key=lambda t: t[1], reverse=True)
    if not cands:
        return None
    if features:
        for path, _ in cands:
            if set(features) <= set(spark.read.parquet(path).columns):
                return path
    return cands[0][0]


def _local(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it is in a folder that the driver and all executors mount; None for other stores."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(p).toUri().getPath() if fs.getScheme() == "file" else None


def write_documents(docs: DataFrame, path: str, id_col: str) -> None:
    """One text file per id, in a folder ``<id_col>=<id>`` of one of many shards; each text ends with a zero byte.

    A task writes whole shards, so the commit moves shards, not single folders, and a scan lists the shards in parallel tasks.
    Into a mounted folder the tasks write by themselves: Spark's writer starts several processes per file there, to set modes.
    """
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_FILES))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).repartition(shards, "shard")
    root = _local(spark, path)
    if root is None:
        dealt.write.partitionBy("shard", id_col).option("lineSep", "\u0000").text(path)
        return
    os.makedirs(root)   # as errorifexists
    text = next(c for c in docs.columns if c != id_col)
    rows = dealt.select("shard", F.col(id_col).cast("string").alias("id"), F.col(text).cast("binary").alias("text")).sortWithinPartitions("shard", "id")
    with shuffles_freed(spark), settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        rows.mapInArrow(lambda batches: _written(batches, root, id_col), "shard int").write.format("noop").mode("overwrite").save()
    shutil.rmtree(f"{root}/_temporary", ignore_errors=True)
    open(f"{root}/_SUCCESS", "w").close()


#: Characters that Spark's writer escapes in the names of partition folders.
_ESCAPES = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}


def _written(batches: Iterator[pa.RecordBatch], root: str, id_col: str) -> Iterator[pa.RecordBatch]:
    """Write rows sorted by shard and id; a shard gets its name when it is whole, from the first attempt that has it so."""
    attempt = f"{root}/_temporary/{uuid.uuid4().hex}"
    at = name = out = None

    def finish() -> None:
        if out is not None:
            out.close()
        if at is not None:
            try:
                os.rename(f"{attempt}/shard={at}", f"{root}/shard={at}")
            except OSError:
                if not os.path.isdir(f"{root}/shard={at}"):
                    raise

    for batch in batches:
        for shard, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            folder = f"{id_col.translate(_ESCAPES)}={key.translate(_ESCAPES) if key else '__HIVE_DEFAULT_PARTITION__'}"
            if shard != at:
                finish()
                at, name, out = shard, None, None
                os.makedirs(f"{attempt}/shard={shard}")
            if folder != name:
                if out is not None:
                    out.close()
                name = folder
                os.mkdir(f"{attempt}/shard={shard}/{folder}")
                out = open(f"{attempt}/shard={shard}/{folder}/part-00000.txt", "wb")
            out.write((text or b"") + b"\0")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["shard"])
    finish()


def _hidden(name: str) -> bool:
    """Names that Spark's scans leave out."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _wanted(name: str) -> bool:
    return any(fnmatchcase(name, f"*.{e}") for e in DOC_EXT)


def _files(folder: str) -> Iterator[str]:
    """Documents at any depth below a folder."""
    for e in os.scandir(folder):
        if not _hidden(e.name):
            if e.is_dir():
                yield from _files(e.path)
            elif _wanted(e.name):
                yield e.path


def _uri(path: str) -> str:
    """As in ``_metadata.file_path``."""
    return "file:" + re.sub(r"[^\w/@,;:$&+=.!~*'()-]", lambda m: quote(m[0]) if m[0] < "\x80" else m[0], path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, text) of every document in folders or files."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["source", "text"])

    rows, size = [], 0
    for b in batches:
        for top in b.column(0).to_pylist():
            for path in _files(top) if os.path.isdir(top) else [top]:
                with open(path, "rb") as f:
                    rows.append((_uri(path), f.read()))
                size += len(rows[-1][1])
                if size > BATCH_BYTES or len(rows) >= 20 * BATCH_ROWS:
                    yield batch(rows)
                    rows, size = [], 0
    if rows:
        yield batch(rows)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Recursive scan of ``.md/.txt/.markdown`` files, one row per file (whole text); blank files are left out.

    Below a mounted folder the driver lists as many levels as give the tasks folders enough; they list the rest and read.
    Spark's scan, used for other stores, has every single file on the driver and few small files in a task.
    """
    root = _local(spark, path)
    if root is not None and os.path.isdir(root):
        level, found, enough = [root], [], 2 * spark.sparkContext.defaultParallelism
        while level and len(level) < enough:
            inside = [e for folder in level for e in os.scandir(folder) if not _hidden(e.name)]
            found += [e.path for e in inside if not e.is_dir() and _wanted(e.name)]
            level = [e.path for e in inside if e.is_dir()]
        tops = spark.createDataFrame([(p,) for p in sorted(level) + found], "path string")
        df = tops.repartition(max(1, min(len(level) + len(found), max(enough, len(level))))).mapInArrow(_texts, "source string, text binary")
        df = df.select("source", F.col("text").cast("string").alias("text"))
    else:
        glob = "*.{" + ",".join(DOC_EXT) + "}"
        df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        df = df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return df.where(~F.col("text").rlike(r"(?U)^\s*$"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 multi_line: bool = False) -> DataFrame:
    """JSON records (one object per line; ``multi_line`` for whole-file arrays)."""
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r).json(path)


def export_csv(df: DataFrame, path: str, id_col: str | None, columns: list[str], score_col: str = "risk_score",
               encoding: str = "UTF-8", sep: str = ",") -> None:
    """All fields quoted, quotes doubled, header ``[id, columns..., score_risque]``; no row cap."""
    cols = ([F.col(id_col).alias("id")] if id_col else []) + [F.col(c) for c in columns] + \
        [F.col(score_col).alias("score_risque")]
    (df.select(*cols).write.mode("errorifexists").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("sep", sep).option("encoding", encoding).csv(path))
