"""SparkSession construction and cluster-safe helpers.

The library never sets cluster-wide storage locations when the cluster already
names them: ``spark.checkpoint.dir`` is read from the session and only filled in
for local runs (tests, bench) where it is unset.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the library relies on (UTC timestamps, AQE with skew-join
# splitting, NULL-safe map merge for what-if overrides).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Let AQE switch a sort-merge join to a shuffled hash join when every
    # post-shuffle partition of the build side is small (no sort of the big side,
    # and no unbounded hash table: above the threshold the sort-merge join stays).
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # No broadcast from static size estimates: a table derived from text (explode,
    # aggregate) is estimated from its input file size and can be far larger than
    # the guess. Broadcasts are either explicit on bounded tables or chosen by AQE
    # from the measured size of a finished shuffle stage.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "attrix") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("ATTRIX_DRIVER_MEMORY", "8g")))
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators expect to an existing session."""
    for k, v in SESSION_DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    # Local runs only (tests, bench): driver and executors are one process, so a fresh scratch folder is shared.
    local = tempfile.mkdtemp(prefix="attrix-ckpt-")
    sc.setCheckpointDir(local)
    return local


#: Spark's setting that frees the shuffle files of a finished execution at once; what it wrote is read from storage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """Executions inside have these settings."""
    before = {k: spark.conf.get(k, None) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions inside (writes of whole tables) leave no shuffle files behind."""
    with settings(spark, {CLEANUP: "true"}):
        yield


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
