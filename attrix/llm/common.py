"""Helpers shared by the corpus operators: tables on shared storage, blocks of documents, rolling hashes.

Documents reach an operator as any DataFrame with an id and a text column. Operators look at those two
columns only, so further columns (also ones with clashing names) do no harm.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import ensure_checkpoint_dir

#: Text bytes in a block of documents (the unit that meets its own automaton or side table in one task).
BLOCK_BYTES = 4 << 20
#: Texts in a batch sent to a Python worker.
BATCH_ROWS = 500
#: Blocks per shuffle partition at least, so that hashing blocks to partitions stays even.
BLOCKS_PER_PARTITION = 4
#: Spark's setting that frees the shuffle files of a finished execution at once; what it wrote is read from storage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name on the storage that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrix-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing will read again: what was made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_of(blocks: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def with_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, text, block[, row]): ids are dealt to blocks by hash; the number of blocks follows the size of the text.

    ``row`` has the other columns of the input, as one struct, so that no name clashes.
    """
    docs = documents(docs, id_col, text_col, keep)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(BLOCKS_PER_PARTITION * shuffle_partitions(docs.sparkSession), -(-total // BLOCK_BYTES))
    return docs.withColumn("block", block_of(blocks)), blocks


def documents(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """(doc_id, text[, row]): ``row`` is a struct of all input columns.

    Rows with whole texts are large, so the session is set to send them to Python in small batches.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if keep else []))


def restored(df: DataFrame, text: str, text_col: str = "text") -> DataFrame:
    """The columns of ``row`` with a new text; ``n_chars``, if there, counts it."""
    new = {text_col: F.col(text)} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in df.schema["row"].dataType.names else {})
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.schema["row"].dataType.names])


def row_schema(df: DataFrame) -> str:
    """The ``row`` column for the schema of a function over Arrow batches, if there is one."""
    return ", row " + df.schema["row"].dataType.simpleString() if "row" in df.columns else ""


def copies(docs: DataFrame) -> DataFrame:
    """Exact copies: (doc_id, first_id, copies) of every text that more than one id has; null ids take no part."""
    texts = docs.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).distinct()
    groups = texts.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return texts.join(groups, "sha").select("doc_id", "first_id", "copies")


_FACTOR = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        both = []
        for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            p = np.full(size, f, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = tuple(both)
    return _powers


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all k-symbol windows of a sequence of 64-bit symbol hashes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.inverse = powers(n + 1)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(n + 1)[0][:n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return scrambled((self.sums[k:] - self.sums[:-k]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


#: A random 64-bit symbol for every byte.
BYTE = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of a text: runs of bytes other than ASCII white space."""
    symbols = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[symbols], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    roll = Rolling(BYTE[symbols])
    return scrambled((roll.sums[ends] - roll.sums[starts]) * roll.inverse[starts] + (ends - starts).astype(np.uint64)), starts, ends


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n positions that lie in a window of ``width`` starting at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
