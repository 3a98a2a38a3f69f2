"""M-group queries: streaming jobs over file copies of the tables (availableNow triggers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from ..operators.rules import rule_score
from ..sources import fixtures
from ..sources.files import scratch_path
from ..sources.keyed import KeyedTable
from ..sources.tables import read_table
from ..streaming import jobs as M
from .catalog import register
from .oracle_views import DEMO, SCORED, with_
from .q_rules import score_sql


@register("stream_score", with_(SCORED) + """
SELECT CustomerId, risk_score,
       CASE WHEN risk_score > 70 THEN 'eleve' WHEN risk_score >= 30 THEN 'moyen' ELSE 'faible' END AS risk_level
FROM scored""")
def stream_score(spark, sf):
    churn = fixtures.churn(spark, sf)
    src = M.stage_source(churn, "churn")
    out, ck = scratch_path(spark, "m1-out"), scratch_path(spark, "m1-ck")
    M.run(M.score_stream(M.file_stream(spark, src, churn.schema), lambda: F.expr(fixtures.FIXED_LOGIT_SQL), out, ck))
    return spark.read.parquet(out).select("CustomerId", "risk_score", "risk_level")


def _events_with_level(spark, sf, stream=True):
    events = read_table(spark, sf, "events")
    demo = fixtures.demo_clients(spark, sf).select("id", rule_score().alias("rule_score"))
    if stream:
        src = M.stage_source(events, "events")
        events = M.file_stream(spark, src, events.schema)
        # The static side of a stream-static join is re-evaluated in every micro-batch:
        # write the per-customer scores once (shared scratch folder), join the table.
        demo = M.materialise(demo, "m4-static")
    # Stream-static join on the customer key (the static side is a table, not broadcast).
    return events.join(demo, events.user_id == demo.id).withColumn("level", risk_level("rule_score"))


@register("stream_risk_by_day", with_(DEMO) + f"""
SELECT date_trunc('day', e.ts) AS window_start,
       CASE WHEN s > 70 THEN 'eleve' WHEN s >= 30 THEN 'moyen' ELSE 'faible' END AS level, count(*) AS n
FROM events e JOIN (SELECT id, {score_sql()} AS s FROM demo) d ON e.user_id = d.id
GROUP BY 1, 2""")
def stream_risk_by_day(spark, sf):
    s = _events_with_level(spark, sf)
    out, ck = scratch_path(spark, "m4-out"), scratch_path(spark, "m4-ck")
    M.run(M.windowed_counts(s, "ts", ["level"], "1 day", "1 day", out, ck))
    return M.latest_state(spark, out, ["window_start", "level"], ["n"])


_REF_CUTOFF = "2024-01-11"


@register("stream_drift", f"""
WITH ref AS (SELECT event_type AS bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p_ref
             FROM events WHERE ts < TIMESTAMP '{_REF_CUTOFF}' GROUP BY 1),
win AS (SELECT date_trunc('day', ts) AS window_start, event_type AS bin, count(*) AS n FROM events GROUP BY 1, 2),
sh AS (SELECT window_start, bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY window_start) AS p_new FROM win),
j AS (SELECT w.window_start, greatest(coalesce(r.p_ref, 0), 1e-4) AS pr, greatest(coalesce(s.p_new, 0), 1e-4) AS pn
      FROM (SELECT DISTINCT window_start FROM sh) w
      CROSS JOIN (SELECT bin FROM ref UNION SELECT bin FROM sh) b
      LEFT JOIN ref r ON r.bin = b.bin LEFT JOIN sh s ON s.window_start = w.window_start AND s.bin = b.bin)
SELECT window_start, round_even(sum((pn - pr) * ln(pn / pr)) * 10000, 0) / 10000 AS psi FROM j GROUP BY 1""")
def stream_drift(spark, sf):
    from ..operators.drift import EPSILON
    events = read_table(spark, sf, "events")
    before = events.where(F.col("ts") < F.lit(_REF_CUTOFF).cast("timestamp_ntz"))
    ref_total = before.select(F.count(F.lit(1))).scalar()
    ref = (before.groupBy(F.col("event_type").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
           .select("bin", (F.col("n") / ref_total).alias("p_ref")))
    src = M.stage_source(events.withColumnRenamed("event_type", "bin"), "events-drift")
    stream = M.file_stream(spark, src, events.withColumnRenamed("event_type", "bin").schema)
    out, ck = scratch_path(spark, "m2-out"), scratch_path(spark, "m2-ck")
    M.run(M.windowed_counts(stream, "ts", ["bin"], "1 day", "1 day", out, ck))
    counts = M.latest_state(spark, out, ["window_start", "bin"], ["n"])
    tot = counts.groupBy("window_start").agg(F.sum("n").alias("t"))
    new = counts.join(tot, "window_start").select("window_start", "bin", (F.col("n") / F.col("t")).alias("p_new"))

    def term(p_new, p_ref):
        pn = F.greatest(F.coalesce(p_new, F.lit(0.0)), F.lit(EPSILON))
        pr = F.greatest(F.coalesce(p_ref, F.lit(0.0)), F.lit(EPSILON))
        return (pn - pr) * F.ln(pn / pr)

    # PSI over the union of bins without pairing windows with reference bins:
    # window bins contribute term(p_new, p_ref); reference bins missing from the
    # window contribute term(0, p_ref) = (sum over all reference bins) - (those present).
    all_ref = ref.select(F.sum(term(F.lit(0.0), F.col("p_ref")))).scalar()
    # One row per category, but categories are not bounded in general: no broadcast
    # hint; AQE broadcasts the reference only when its aggregate measured small.
    j = new.join(ref, "bin", "left")
    per = j.groupBy("window_start").agg(
        F.sum(term(F.col("p_new"), F.col("p_ref"))).alias("present"),
        F.sum(F.when(F.col("p_ref").isNotNull(), term(F.lit(0.0), F.col("p_ref"))).otherwise(F.lit(0.0))).alias("seen"))
    return per.select("window_start",
                      (F.rint((F.col("present") + all_ref - F.col("seen")) * 10000) / 10000).alias("psi"))


@register("stream_dedupe", """
WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT k.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts > k.ts + INTERVAL 1800 SECOND GROUP BY 1)
SELECT user_id, ts FROM kept""")
def stream_dedupe(spark, sf):
    events = read_table(spark, sf, "events")
    src = M.stage_source(events, "events-dedupe")
    out, ck = scratch_path(spark, "m3-out"), scratch_path(spark, "m3-ck")
    M.run(M.dedupe_within_ttl(M.file_stream(spark, src, events.schema), "user_id", "ts", 1800, out, ck))
    return spark.read.parquet(out).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("stream_append", """
SELECT DISTINCT lower(c_name) AS username, c_name AS full_name FROM customer""")
def stream_append(spark, sf):
    users, _, _, _ = fixtures.registry_tables(spark, sf)
    users = users.select("username", "full_name")
    src = M.stage_source(users, "users")
    target = scratch_path(spark, "m5-target")
    for _ in range(2):      # the second run replays every file: nothing new is appended
        M.run(M.idempotent_append(M.file_stream(spark, src, users.schema), "username", target,
                                  scratch_path(spark, "m5-ck")))
    return KeyedTable(spark, target, users.schema, "username").read()
