"""Model registry as tables (J1-J10) and the idempotent append.

State is two append-only tables - ``versions`` and ``activations`` (plus
``tombstones`` for deletions) - so every question is a query: the current
version of a scope is ``max_by(version, ts)``, a listing is a filter + join.
Appends never rewrite files, which keeps concurrent writers and executor loss
safe (a failed append leaves no partial version row because the model files are
written before the row that points at them).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display labels of well-known targets.
TARGET_LABELS = {"Exited": "Banque - Churn client", "Attrition": "RH - Depart employe"}

VERSION_SCHEMA = ("version string, ts timestamp, username string, organisation_id int, target string, "
                  "dataset string, algorithm string, features array<string>, classes array<string>, "
                  "reason string, model_path string")
ACTIVATION_SCHEMA = "scope string, version string, ts timestamp"


def new_version_id(now: _dt.datetime | None = None) -> str:
    """UTC second stamp plus a short random suffix (no same-second collisions, Q21)."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return now.strftime("%Y%m%dT%H%M%S") + "_" + uuid.uuid4().hex[:6]


def register_version(spark: SparkSession, root: str, model, meta: dict, activate_scope: str | None = "global") -> str:
    """Save the fitted pipeline, then append its version row (and activation)."""
    version = new_version_id()
    path = f"{root.rstrip('/')}/models/{version}"
    model.write().overwrite().save(path)
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = (version, now, meta.get("username"), meta.get("organisation_id"), meta.get("target"),
           meta.get("dataset"), meta.get("algorithm"), list(meta.get("features", [])),
           list(meta.get("classes", [])), meta.get("reason"), path)
    spark.createDataFrame([row], VERSION_SCHEMA).write.mode("append").parquet(f"{root}/versions")
    if activate_scope:
        activate(spark, root, version, activate_scope)
    return version


def activate(spark: SparkSession, root: str, version: str, scope: str = "global") -> None:
    """Append an activation; unknown versions are refused."""
    known = spark.read.parquet(f"{root}/versions").where(F.col("version") == version).limit(1).count()
    if not known:
        raise FileNotFoundError(f"version not found: {version}")
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(scope, version, now)], ACTIVATION_SCHEMA).write.mode("append").parquet(
        f"{root}/activations")


def list_versions(versions: DataFrame) -> DataFrame:
    """Newest first."""
    return versions.orderBy(F.col("version").desc())


def current_versions(activations: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Latest activation per scope (``max_by``: partial aggregation, skew-safe)."""
    acts = activations
    if tombstones is not None:
        acts = acts.join(tombstones.select("version"), "version", "left_anti")
    return acts.groupBy("scope").agg(F.max_by("version", F.struct("ts", "version")).alias("version"))


def delete_versions(requests: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome per requested version: ``not_found``, ``refused_active`` (active in any
    scope, Q20) or ``deleted`` (a tombstone row to append)."""
    known = versions.select("version").distinct().withColumn("__known", F.lit(True))
    active = current.select("version").distinct().withColumn("__active", F.lit(True))
    x = requests.select("version").distinct().join(known, "version", "left").join(active, "version", "left")
    return x.select("version", F.when(F.col("__known").isNull(), "not_found")
                    .when(F.col("__active").isNotNull(), "refused_active").otherwise("deleted").alias("outcome"))


def model_label(target: Column, dataset: Column) -> Column:
    """Known target label, else cleaned file name title-cased (+ target), else text."""
    known = F.lit(None).cast("string")
    for t, lbl in TARGET_LABELS.items():
        known = F.when(target == t, F.lit(lbl)).otherwise(known)
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.trim(dataset), r"\.[^.]*$", ""), "[_-]", " "))
    pretty = F.initcap(stem)
    from_file = F.when(F.length(stem) > 0, F.when(F.length(F.trim(target)) > 0,
                                                  F.concat(pretty, F.lit(" ("), target, F.lit(")")))
                       .otherwise(pretty))
    from_target = F.when(F.length(F.trim(target)) > 0, F.concat(F.lit("Prediction "), target)).otherwise("Modele")
    return F.coalesce(known, from_file, from_target)


def visible(versions: DataFrame, viewer: dict | None) -> DataFrame:
    """No viewer -> all; admin -> own organisation or none; otherwise own versions."""
    if viewer is None:
        return versions
    if viewer.get("role") == "admin":
        return versions.where(F.col("organisation_id").isNull()
                              | (F.col("organisation_id") == F.lit(viewer.get("organisation_id"))))
    return versions.where(F.col("username") == F.lit(viewer.get("username")))


def catalogue(versions: DataFrame, users: DataFrame, active_version: str | None, viewer: dict | None) -> DataFrame:
    """Visible versions with label, target, algorithm, feature count, date, active flag
    and (for an admin) the owner's full name from the users table (left join on username)."""
    v = visible(versions, viewer)
    owners = users.select("username", F.col("full_name").alias("owner_name"), F.col("organisation_id").alias("__org"))
    if viewer is not None and viewer.get("role") == "admin":
        owners = owners.where(F.col("__org") == F.lit(viewer.get("organisation_id")))
    else:
        owners = owners.where(F.lit(False))
    out = v.join(owners.drop("__org"), "username", "left")
    return out.select("version", model_label(F.col("target"), F.col("dataset")).alias("label"), "target",
                      "algorithm", F.size("features").alias("n_features"), "ts",
                      (F.col("version") == F.lit(active_version)).alias("active") if active_version
                      else F.lit(False).alias("active"), "username", "owner_name")


def latest_per_owner_label(catalogue_df: DataFrame) -> DataFrame:
    """One entry per (owner, label): the active one, else the newest (``max_by``)."""
    return (catalogue_df.groupBy("username", "label")
            .agg(F.max_by("version", F.struct(F.col("active").cast("int"), F.col("version"))).alias("version")))


def backfill_active(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Scopes (owners) without an activation get their newest version as new activation rows."""
    owners = versions.select(F.col("username").alias("scope"), "version").where(F.col("scope").isNotNull())
    missing = owners.join(current.select("scope"), "scope", "left_anti")
    return missing.groupBy("scope").agg(F.max("version").alias("version"))


def append_unseen(new: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` whose key is absent from ``existing`` (left anti join), and the
    ``(status, n)`` counts of migrated / skipped rows."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    marked = new.join(existing.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    counts = marked.groupBy(F.when(F.col("__seen").isNull(), "migrated").otherwise("skipped").alias("status")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return fresh, counts
