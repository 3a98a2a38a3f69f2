"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each entry may carry the equivalent DuckDB SQL used as the correctness oracle.
Entries without SQL (model fits, sampled algorithms, streams) are checked on
rows only and by the property tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that their ``register`` calls run."""
    import importlib
    for mod in PLAN_MODULES:
        try:
            importlib.import_module(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__package__}.{mod}":
                raise


PLAN_MODULES = ("q_views", "q_profile", "q_clean", "q_drift", "q_rules", "q_recommend",
                "q_retrieve", "q_train", "q_explain", "q_attribution", "q_registry", "q_sources", "q_stream", "q_compose", "q_misc")
