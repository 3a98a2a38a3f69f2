"""Parquet table access for the driver's star schema and any landed dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filter pushdown reach the reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view so SQL and DataFrame code share names."""
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN apart from NULL; the data contract treats both as missing."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType))
                         .otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the cluster has cores.

    Text tables stored as a few large row groups scan as one task each; CPU-heavy
    per-row work (chunking, tokenising) would then run on one core. On a large
    multi-file table the scan already has enough partitions and this is a no-op.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(target) if df.rdd.getNumPartitions() < target // per_core else df
