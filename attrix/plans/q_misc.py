"""L-group scalar functions, landing / catalogue round trips, document scans, reuse TTL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as L
from ..operators import drift as D
from ..operators import profile as P
from ..operators import recommend as I
from ..sources import files as A
from ..sources import fixtures
from ..sources.tables import read_table
from .catalog import register
from .oracle_views import SCORED, with_

_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
_PLACE = f"translate(n_name, 'AEIOU', 'ÀÉÎÖÛ')"


@register("scalar_functions", f"""
WITH c AS (SELECT c.c_custkey, c.c_name, c.c_mktsegment, c.c_acctbal, {_PLACE} AS place, {_EMAIL} AS email
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
e AS (SELECT *, split_part(email, '@', 1) AS loc, substr(email, strpos(email, '@') + 1) AS dom FROM c)
SELECT c_custkey,
       CASE WHEN length(loc) <= 2 THEN substr(loc, 1, 1) || repeat('*', length(loc) - 1)
            ELSE substr(loc, 1, 1) || repeat('*', length(loc) - 2) || right(loc, 1) END || '@' || dom AS masked,
       coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) AS email_ok,
       regexp_replace(c_name, '[^A-Za-z0-9._@-]', '_', 'g') AS slug,
       lower(regexp_replace(translate(place, '{L._ACCENTED}', '{L._PLAIN}'), '[^A-Za-z]', '', 'g')) AS ascii_place,
       upper(substr(lower(c_mktsegment), 1, 1)) || lower(substr(lower(c_mktsegment), 2)) AS segment_cap,
       coalesce(regexp_replace(regexp_replace(printf('%.2f', c_acctbal), '0+$', ''), '\\.$', ''), '') AS balance_txt,
       sha256(c_name) AS name_sha
FROM e""")
def scalar_functions(spark, sf):
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    x = c.join(F.broadcast(n.select("n_nationkey", "n_name")), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.expr(_PLACE).alias("place"), F.expr(_EMAIL).alias("email"))
    return x.select("c_custkey", L.mask_email("email").alias("masked"), L.email_valid("email").alias("email_ok"),
                    L.safe_slug("c_name").alias("slug"), L.ascii_slug("place").alias("ascii_place"),
                    L.capitalize_first(F.lower("c_mktsegment")).alias("segment_cap"),
                    L.display_value("c_acctbal", "double").alias("balance_txt"), L.sha256("c_name").alias("name_sha"))


@register("score_labels", with_(SCORED) + """
SELECT CustomerId, CAST(CAST(round_even(risk_score, 0) AS BIGINT) AS VARCHAR) || '%' AS score_pct,
       CASE WHEN risk_score > 70 THEN 'élevé' WHEN risk_score >= 30 THEN 'moyen' ELSE 'faible' END AS level_label
FROM scored""")
def score_labels(spark, sf):
    s = fixtures.scored(spark, sf)
    return s.select("CustomerId", L.score_percent("risk_score").alias("score_pct"),
                    L.level_label(L.risk_level("risk_score")).alias("level_label"))


@register("landing_roundtrip", with_(SCORED) + """
SELECT CustomerId, Surname, Geography, Segment, Balance, EstimatedSalary, Age, NumOfProducts, Tenure,
       IsActiveMember, Exited FROM scored""")
def landing_roundtrip(spark, sf):
    """Land two versions (the newer one lacks a model feature), pick the newest
    version holding every feature, and round-trip its profile (A8-A9) and drift
    reference (A10) through their sinks."""
    churn = fixtures.churn(spark, sf)
    root = A.scratch_path(spark, "landing")
    A.land_dataset(churn, root, "clients")
    import time
    time.sleep(1.1)                                  # distinct modification times
    A.land_dataset(churn.drop("Tenure"), root, "clients")
    chosen = A.newest_dataset(spark, root, features=["Age", "Tenure", "Balance"])
    df = spark.read.parquet(chosen)
    prof = P.build_profile(df, target="Exited").to_frame(spark)
    A.write_profile(prof, root + "/schema")
    back = A.read_profile(spark, root + "/schema", P.PROFILE_SCHEMA)
    feats = [r["name"] for r in back.where("role = 'feature'").collect()]
    A.write_reference(D.build_reference(df, feats), root + "/drift")
    ref = A.read_reference(spark, root + "/drift")
    assert ref is not None and A.read_reference(spark, root + "/missing") is None
    return df.select(*[c for c in churn.columns])


@register("documents_scan", """
SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents""")
def documents_scan(spark, sf):
    """Documents written one file per document, scanned back recursively (whole text)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    root = A.scratch_path(spark, "docs")
    A.write_documents(docs, root, "doc_id")
    scanned = A.read_documents(spark, root)
    doc_id = F.regexp_extract("source", r"doc_id=(\d+)", 1).cast("bigint")
    text = F.regexp_replace("text", "\u0000$", "")
    return scanned.select(doc_id.alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"),
                          F.md5(text).alias("text_md5"))


# A prior result is fresh iff its age (abs(Balance) % 3600 s, at microsecond precision) is under the TTL.
@register("reuse_ttl", with_(SCORED) + """
SELECT CustomerId, CASE WHEN CAST(abs(Balance) % 3600 AS DECIMAL(18, 6)) <= 1800 THEN 'reused' ELSE 'computed' END AS status
FROM scored""")
def reuse_ttl(spark, sf):
    """Requests reuse prior results younger than 1800 s; the others are recomputed."""
    s = fixtures.scored(spark, sf).drop("p")
    req = s.select("CustomerId", I.reuse_key(s.select("CustomerId", "risk_score")).alias("reuse_key"))
    # Prior results: one per customer, aged by its account balance (seconds).
    prior = s.select(I.reuse_key(s.select("CustomerId", "risk_score")).alias("reuse_key"),
                     (F.current_timestamp() - F.make_dt_interval(secs=F.abs(F.col("Balance")) % 3600))
                     .alias("created_at"), F.lit("regles_secours").alias("source"))
    reused, todo = I.reuse_within_ttl(req, prior, 1800)
    return reused.select("CustomerId", F.lit("reused").alias("status")).unionByName(
        todo.select("CustomerId", F.lit("computed").alias("status")))
