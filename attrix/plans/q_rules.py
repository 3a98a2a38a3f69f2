"""R-group queries on the demo client table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources import fixtures
from .catalog import register
from .oracle_views import DEMO, with_

_D = "CAST({} AS DOUBLE)"
_SCORE_SQL = """CAST(floor(least(98.0, greatest(3.0,
   32.0 + greatest(0, 24 - {t}) * CAST(1.1 AS DOUBLE)
   + CASE {c} WHEN 'Mensuel' THEN 22.0 WHEN 'Annuel' THEN -6.0 WHEN 'Bi-annuel' THEN -14.0 END
   + {k} * CAST(2.4 AS DOUBLE) + greatest(0, {l} - 30) * CAST(0.35 AS DOUBLE)
   + (7 - {s}) * 4 + (4 - {p}) * 3 + CASE WHEN monthlyCharges > 120 THEN 6.0 ELSE 0.0 END)) + 0.5) AS INTEGER)"""


def score_sql(t="tenureMonths", c="contract", k="supportTickets", l="lastInteractionDays", s="satisfaction",  # noqa: E741
              p="products"):
    return _SCORE_SQL.format(t=t, c=c, k=k, l=l, s=s, p=p)


@register("rule_score", with_(DEMO) + f"SELECT id, {score_sql()} AS score FROM demo")
def rule_score(spark, sf):
    return fixtures.demo_clients(spark, sf).select("id", R.rule_score().alias("score"))


_CONTRIB_SQL = with_(DEMO) + """
, c AS (
  SELECT id, 0 AS ord, 'contract' AS feature, CASE contract WHEN 'Mensuel' THEN 22 WHEN 'Annuel' THEN -6 ELSE -14 END AS contribution FROM demo
  UNION ALL SELECT id, 1, 'satisfaction', CAST(floor((7 - satisfaction) * 4 - 6 + 0.5) AS INTEGER) FROM demo
  UNION ALL SELECT id, 2, 'support_tickets', CAST(floor(supportTickets * CAST(2.4 AS DOUBLE) - 6 + 0.5) AS INTEGER) FROM demo
  UNION ALL SELECT id, 3, 'tenure', CAST(floor(greatest(0, 24 - tenureMonths) * CAST(1.1 AS DOUBLE) - 8 + 0.5) AS INTEGER) FROM demo
  UNION ALL SELECT id, 4, 'last_interaction', CAST(floor(greatest(0, lastInteractionDays - 30) * CAST(0.35 AS DOUBLE) - 4 + 0.5) AS INTEGER) FROM demo
  UNION ALL SELECT id, 5, 'products', CAST(floor((4 - products) * 3 - 3 + 0.5) AS INTEGER) FROM demo)
SELECT id, rank, feature, contribution FROM (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, ord) AS rank, feature, contribution FROM c)
WHERE rank <= 5"""


@register("rule_contributions", _CONTRIB_SQL)
def rule_contributions(spark, sf):
    df = fixtures.demo_clients(spark, sf)
    return (df.select("id", F.posexplode(R.rule_contributions(df)).alias("pos", "c"))
            .select("id", (F.col("pos") + 1).alias("rank"), "c.feature", "c.contribution"))


@register("rule_actions", with_(DEMO) + """
, a AS (
  SELECT id, 0 AS ord, 'r-contract' AS rec_id, 18 AS impact, 'Haute' AS priority FROM demo WHERE contract = 'Mensuel'
  UNION ALL SELECT id, 1, 'r-csm', 14, 'Haute' FROM demo WHERE satisfaction <= 3
  UNION ALL SELECT id, 2, 'r-support', 11, 'Moyenne' FROM demo WHERE supportTickets >= 5
  UNION ALL SELECT id, 3, 'r-reengage', 9, 'Moyenne' FROM demo WHERE lastInteractionDays > 45
  UNION ALL SELECT id, 4, 'r-crosssell', 7, 'Basse' FROM demo WHERE products < 3),
b AS (SELECT * FROM a UNION ALL SELECT id, 0, 'r-monitor', 3, 'Basse' FROM demo WHERE id NOT IN (SELECT id FROM a))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) AS rank, rec_id, impact, priority FROM b""")
def rule_actions(spark, sf):
    df = fixtures.demo_clients(spark, sf)
    return (df.select("id", F.posexplode(R.rule_actions()).alias("pos", "a"))
            .select("id", (F.col("pos") + 1).alias("rank"), F.col("a.id").alias("rec_id"), "a.impact", "a.priority"))


def scenarios():
    """Rule what-if scenarios (built on call: Columns need an active session)."""
    return [("satisfaction_max", {"satisfaction": 6}),
            ("no_tickets", {"supportTickets": 0}),
            ("recent_contact", {"lastInteractionDays": 0}),
            ("one_more_product", {"products": F.least(F.col("products") + 1, F.lit(6))}),
            ("annual_contract", {"contract": "Annuel"})]


@register("rule_what_if", with_(DEMO) + f"""
, s AS (
  SELECT id, 'satisfaction_max' AS scenario, {score_sql(s='6')} AS new_score FROM demo
  UNION ALL SELECT id, 'no_tickets', {score_sql(k='0')} FROM demo
  UNION ALL SELECT id, 'recent_contact', {score_sql(l='0')} FROM demo
  UNION ALL SELECT id, 'one_more_product', {score_sql(p='least(products + 1, 6)')} FROM demo
  UNION ALL SELECT id, 'annual_contract', {score_sql(c="'Annuel'")} FROM demo)
SELECT s.id, s.scenario, b.base_score, s.new_score, s.new_score - b.base_score AS delta
FROM s JOIN (SELECT id, {score_sql()} AS base_score FROM demo) b ON s.id = b.id""")
def rule_what_if(spark, sf):
    return R.rule_what_if(fixtures.demo_clients(spark, sf), scenarios())


@register("demo_kpis", with_(DEMO) + f""",
s AS (SELECT {score_sql()} AS risk_score FROM demo)
SELECT count(*) AS total, count(*) FILTER (WHERE risk_score > 70) AS at_risk_count,
       floor(count(*) FILTER (WHERE risk_score > 70) * CAST(1.0 AS DOUBLE) / count(*) * 1000 + 0.5) / 10 AS at_risk_pct,
       floor(count(*) FILTER (WHERE risk_score > 50) * CAST(1.0 AS DOUBLE) / count(*) * 1000 + 0.5) / 10 AS avg_churn_rate,
       floor(CAST(coalesce(sum(risk_score), 0) AS DOUBLE) / greatest(count(*), 1) * 10 + 0.5) / 10 AS avg_score
FROM s""")
def demo_kpis(spark, sf):
    """Dashboard KPIs of the demo client table (rule score, Math.round rounding)."""
    d = fixtures.demo_clients(spark, sf).select(R.rule_score().alias("risk_score"))
    return R.demo_dashboard_kpis(d)


@register("demo_top_risk", with_(DEMO) + f"""
SELECT id, {score_sql()} AS risk_score FROM demo ORDER BY risk_score DESC, id LIMIT 10""")
def demo_top_risk(spark, sf):
    """The 10 demo clients with the highest rule score (ties by id), TakeOrderedAndProject."""
    from ..operators import views as V
    d = fixtures.demo_clients(spark, sf).select("id", R.rule_score().alias("risk_score"))
    return V.top_clients(d, 10, id_col="id")
