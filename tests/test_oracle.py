"""Registered queries against their DuckDB oracle on the smallest scale factor."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

FAST = ["scored_levels", "risk_distribution", "risk_histogram", "dashboard_kpis", "clients_page", "top_risk",
        "monthly_rate", "profile_stats", "column_roles", "leak_scores", "class_balance", "impute_median_mode",
        "clean_table", "psi_report", "psi_shifted", "rule_score", "rule_contributions", "rule_actions",
        "rule_what_if", "fallback_actions", "retention_plan", "alert_mail", "stratified_split", "fold_assignment",
        "confusion_metrics", "roc_auc_exact", "leaderboard", "validate_records", "what_if_grid", "best_action",
        "ablation_contrib", "linear_contrib", "chunk_documents", "tfidf_search", "model_catalogue",
        "latest_per_owner", "delete_versions", "append_unseen", "csv_roundtrip", "latin1_roundtrip",
        "demo_kpis", "demo_top_risk", "formatted_cells", "corpus_changes", "context_blocks", "reuse_ttl",
        "top_report", "clients_rows"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    return v if v is None or isinstance(v, (int, str)) else str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [r["key"] for r in rows] == ["faible", "moyen", "eleve"]
    assert df.columns == ["level", "key", "count"]


def test_every_query_has_a_name_and_callable():
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 60
    assert set(oracle) <= set(qs)
