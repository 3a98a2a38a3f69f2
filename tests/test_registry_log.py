"""Registry by commits: refusals, tombstones, concurrent changes."""

import datetime
import threading
import uuid

import pytest

from attrix.operators.registry import ACTIVATION_SCHEMA, VERSION_SCHEMA
from attrix.operators.registry_log import Registry
from attrix.session import ensure_checkpoint_dir

NOW = datetime.datetime(2026, 1, 1)


def versions(spark, *ids, owner="ann"):
    return spark.createDataFrame([(i, NOW, owner, 1, "y", "d", "a", ["f"], ["0", "1"], None, None) for i in ids], VERSION_SCHEMA)


def acts(spark, *pairs):
    return spark.createDataFrame([(s, v, NOW) for s, v in pairs], ACTIVATION_SCHEMA)


@pytest.fixture()
def registry(spark):
    return Registry(spark, f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}")


def test_changes_and_refusals(spark, registry):
    registry.register(versions(spark, "v1", "v2", "v3"))
    registry.activate(acts(spark, ("ann", "v1")))
    registry.activate(acts(spark, ("ann", "v2"), ("all", "v1")))
    assert {tuple(r) for r in registry.snapshot().current().collect()} == {("ann", "v2"), ("all", "v1")}
    _, outcome = registry.delete(spark.createDataFrame([("v1",), ("v3",), ("v9",)], "version string"))
    assert {tuple(r) for r in outcome.collect()} == {("v1", "refused_active"), ("v3", "deleted"), ("v9", "not_found")}
    assert {r["version"] for r in registry.snapshot().versions().collect()} == {"v1", "v2"}
    for bad in (("ann", "v3"), ("ann", "v9")):
        with pytest.raises(FileNotFoundError):
            registry.activate(acts(spark, bad))
    for again in ("v1", "v3"):
        with pytest.raises(ValueError):
            registry.register(versions(spark, again))
    # Older snapshots stay readable.
    assert {r["version"] for r in registry.snapshot(0).versions().collect()} == {"v1", "v2", "v3"}
    assert registry.snapshot(0).current().collect() == [] and registry.snapshot(-1).versions().collect() == []


def test_backfill(spark, registry):
    registry.register(versions(spark, "a1", "a2").unionByName(versions(spark, "b1", "b2", owner="bob")))
    registry.activate(acts(spark, ("ann", "a1")))
    registry.backfill()
    assert {tuple(r) for r in registry.snapshot().current().collect()} == {("ann", "a1"), ("bob", "b2")}


def test_delete_and_activate_exclude_each_other(spark, registry):
    registry.register(versions(spark, "v1", "v2"))
    done = {}

    def activate():
        try:
            registry.activate(acts(spark, ("ann", "v1")))
            done["activate"] = "done"
        except FileNotFoundError:
            done["activate"] = "refused"

    def delete():
        done["delete"] = {r["outcome"] for r in registry.delete(spark.createDataFrame([("v1",)], "version string"))[1].collect()}

    threads = [threading.Thread(target=f) for f in (activate, delete)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    now = registry.snapshot()
    active, there = [r["version"] for r in now.current().collect()], {r["version"] for r in now.versions().collect()}
    assert (done["activate"], done["delete"], active, there) in (("done", {"refused_active"}, ["v1"], {"v1", "v2"}), ("refused", {"deleted"}, [], {"v2"}))
