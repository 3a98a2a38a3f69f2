"""Tables with one row per key, appended idempotently.

Rows lie in buckets by the hash of their key. An append reads the keys of the buckets that its batch hits and nothing else,
writes the rows whose keys are new to a folder of its own, and commits a manifest that names the folders of every bucket.
Replaying a batch adds nothing; a batch that fails half-way leaves a folder that no manifest names; of two appends at a time
the later one is decided again on what the earlier one left. Snapshots are immutable, so readers never see half a batch.

A null key is a key like any other. Of several rows of a batch with one key the least one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import CommitLog

#: Buckets of a table; folders of a bucket after which ``append`` merges the table's folders.
BUCKETS, MERGE = 64, 64
_BUCKET = "__bucket"


class KeyedTable:
    """The table under ``root``; ``schema`` has the key column."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str):
        self.spark, self.root, self.schema, self.key, self.log = spark, root.rstrip("/"), schema, key, CommitLog(spark, root)

    def _folders(self, number: int) -> dict[str, list[int]]:
        """Folders of a snapshot with the buckets that each holds."""
        return self.log.read(number)["folders"] if number >= 0 else {}

    def _read(self, folders: dict[str, list[int]], columns: list[str], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{f}/{_BUCKET}={b}" for f, held in sorted(folders.items()) for b in held if buckets is None or b in buckets]
        schema = StructType([f for f in self.schema if f.name in columns])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows after a commit, by default the newest."""
        return self._read(self._folders(self.log.latest() if number is None else number), self.schema.names)

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))

    def _written(self, df: DataFrame) -> tuple[str, list[int]]:
        folder = f"{self.root}/{uuid.uuid4().hex}"
        self._bucket(df).write.partitionBy(_BUCKET).parquet(folder)
        held = self.spark.read.schema(f"{_BUCKET} int").parquet(folder).select(_BUCKET).distinct().collect()
        return folder, sorted(r[0] for r in held)

    def _commit(self, change: Callable[[dict[str, list[int]]], dict[str, list[int]] | None]) -> int:
        """Commit what ``change`` makes of the newest snapshot's folders; without a change, that snapshot's number."""
        class Unchanged(Exception):
            pass

        def entry(now: int) -> dict:
            after = change(self._folders(now))
            if after is None:
                raise Unchanged
            return {"folders": after}
        try:
            return self.log.update(entry)
        except Unchanged:
            return self.log.latest()

    def append(self, batch: DataFrame) -> int:
        """Add the rows of ``batch`` whose keys are new; the number of the snapshot that holds them."""
        columns = self.schema.names
        one = batch.select(*columns).groupBy(F.col(self.key).alias("__key")).agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
        # At most BUCKETS numbers.
        hit = {r[0] for r in self._bucket(batch.select(self.key)).select(_BUCKET).distinct().collect()}

        def change(folders: dict[str, list[int]]) -> dict[str, list[int]] | None:
            known = self._read(folders, [self.key], hit).withColumnRenamed(self.key, "__known")
            folder, held = self._written(one.join(known, F.col(self.key).eqNullSafe(F.col("__known")), "left_anti"))
            return folders | {folder: held} if held else None
        number = self._commit(change) if hit else self.log.latest()
        if number >= 0 and len(self._folders(number)) > MERGE:
            self.merge()
        return number

    def merge(self) -> int:
        """Write all rows into one folder, so that a bucket is few files again."""
        def change(folders: dict[str, list[int]]) -> dict[str, list[int]] | None:
            if len(folders) < 2:
                return None
            rows = self._bucket(self._read(folders, self.schema.names)).repartition(_BUCKET, F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4))).drop(_BUCKET)
            folder, held = self._written(rows)
            return {folder: held}
        return self._commit(change)
