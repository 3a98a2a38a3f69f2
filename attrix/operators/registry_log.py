"""Model registry with atomic commits (J1-J5, J10): every change is a numbered commit, readers replay a snapshot.

A change reads the newest snapshot, decides (which versions exist, which are active), writes its rows as Parquet and commits
them under the next number. If another change took that number, the whole decision is made again on the newer snapshot, so
of two changes that exclude each other one wins: a version cannot be deleted while it is made active, and a deleted one
cannot be activated. Nothing is rewritten; a deletion is a tombstone. Rows of changes that never committed are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from .registry import ACTIVATION_SCHEMA, VERSION_SCHEMA, delete_versions

SCHEMAS = {"versions": VERSION_SCHEMA, "activations": ACTIVATION_SCHEMA, "tombstones": "version string"}


@dataclass
class Snapshot:
    """The registry after one commit."""

    spark: SparkSession
    number: int
    folders: dict[str, list[tuple[int, str]]]

    def _rows(self, kind: str) -> DataFrame:
        """All rows of a kind with the number of their commit."""
        out = self.spark.createDataFrame([], SCHEMAS[kind] + ", commit long")
        if self.folders[kind]:
            numbers = F.create_map(*[F.lit(x) for n, f in self.folders[kind] for x in (f.rsplit("/", 1)[1], n)])
            rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*[f for _, f in self.folders[kind]])
            folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
            out = rows.select("*", F.element_at(numbers, folder).cast("long").alias("commit"))
        return out

    def versions(self) -> DataFrame:
        """Versions that are not deleted."""
        return self._rows("versions").join(self._rows("tombstones").select("version").distinct(), "version", "left_anti")

    def current(self) -> DataFrame:
        """(scope, version) by the latest commit, in it by time; deleted versions count for nothing."""
        acts = self._rows("activations").join(self._rows("tombstones").select("version").distinct(), "version", "left_anti")
        return acts.groupBy("scope").agg(F.max_by("version", F.struct("commit", "ts", "version")).alias("version"))


class Registry:
    """Changes of a registry under ``root``; each returns the number of its commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)

    def snapshot(self, number: int | None = None) -> Snapshot:
        folders: dict[str, list[tuple[int, str]]] = {k: [] for k in SCHEMAS}
        last = -1
        for n, entry in self.log.entries():
            if number is None or n <= number:
                folders[entry["kind"]].append((n, entry["folder"]))
                last = n
        return Snapshot(self.spark, last, folders)

    def _change(self, kind: str, decide: Callable[[Snapshot], DataFrame]) -> int:
        def change(now: int) -> dict:
            folder = f"{self.root}/{kind}-{uuid.uuid4().hex}"
            names = [f.split()[0] for f in SCHEMAS[kind].split(", ")]
            decide(self.snapshot(now)).select(*names).write.parquet(folder)
            return {"kind": kind, "folder": folder}
        return self.log.update(change)

    def register(self, versions: DataFrame) -> int:
        """Add version rows; ids that exist, or were deleted, are refused."""
        def decide(s: Snapshot) -> DataFrame:
            twice = versions.groupBy("version").count().where("count > 1").limit(1).count()
            if twice or versions.join(s._rows("versions").select("version"), "version", "left_semi").limit(1).count():
                raise ValueError("a version of this id exists")
            return versions
        return self._change("versions", decide)

    def activate(self, activations: DataFrame) -> int:
        """Make versions active in scopes; versions that are unknown or deleted are refused."""
        def decide(s: Snapshot) -> DataFrame:
            if activations.join(s.versions().select("version"), "version", "left_anti").limit(1).count():
                raise FileNotFoundError("a version was not found")
            return activations
        return self._change("activations", decide)

    def delete(self, requests: DataFrame) -> tuple[int, DataFrame]:
        """Tombstones for the versions that may go; also the outcome of every request, as of that commit."""
        outcome: list[DataFrame] = []

        def decide(s: Snapshot) -> DataFrame:
            outcome[:] = [delete_versions(requests, s.versions(), s.current())]
            return outcome[0].where(F.col("outcome") == "deleted").select("version")
        number = self._change("tombstones", decide)
        return number, outcome[0]

    def backfill(self) -> int:
        """Owners without an active version get their newest one."""
        def decide(s: Snapshot) -> DataFrame:
            owned = s.versions().select(F.col("username").alias("scope"), "version", "ts").where(F.col("scope").isNotNull())
            return owned.join(s.current().select("scope"), "scope", "left_anti").groupBy("scope").agg(
                F.max("version").alias("version"), F.max_by("ts", "version").alias("ts"))
        return self._change("activations", decide)
