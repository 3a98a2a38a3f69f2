"""G-group queries over the scored customer table (plus E1-E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from ..operators import views
from ..operators.profile import identifier_columns
from ..operators.score import prediction
from ..sources import fixtures
from ..sources.tables import read_table
from .catalog import register
from .oracle_views import LOGIT, SCORED, with_

TARGET = "Exited"


def _display(df, n):
    """Display columns from the identifier rule (B2) run on the table itself."""
    base = df.drop("p", "risk_score")
    ids = identifier_columns(base, TARGET)
    return ids, views.display_columns(base.columns, ids, TARGET, n)


@register("scored_levels", with_(SCORED) + """
SELECT CustomerId, risk_score,
       CASE WHEN risk_score > 70 THEN 'eleve' WHEN risk_score >= 30 THEN 'moyen' ELSE 'faible' END AS risk_level,
       CAST(p >= 0.5 AS INTEGER) AS prediction
FROM scored""")
def scored_levels(spark, sf):
    s = fixtures.scored(spark, sf)
    return s.select("CustomerId", "risk_score", risk_level("risk_score").alias("risk_level"),
                    prediction("p").alias("prediction"))


@register("risk_distribution", with_(SCORED) + """
SELECT 'Faible' AS level, 'faible' AS key, count(*) FILTER (WHERE risk_score < 30) AS count FROM scored
UNION ALL SELECT 'Moyen', 'moyen', count(*) FILTER (WHERE risk_score >= 30 AND risk_score <= 70) FROM scored
UNION ALL SELECT 'Élevé', 'eleve', count(*) FILTER (WHERE risk_score > 70) FROM scored""")
def risk_distribution(spark, sf):
    return views.risk_distribution(fixtures.scored(spark, sf))


@register("risk_histogram", with_(SCORED) + """
SELECT CAST(b.i AS INTEGER) AS bin, CAST(b.i * 10 AS VARCHAR) || '–' || CAST(b.i * 10 + 10 AS VARCHAR) AS tranche,
       count(s.risk_score) AS count
FROM range(10) b(i) LEFT JOIN scored s
  ON s.risk_score >= b.i * 10 AND s.risk_score < CASE WHEN b.i = 9 THEN 100.1 ELSE b.i * 10 + 10 END
GROUP BY b.i""")
def risk_histogram(spark, sf):
    return views.risk_histogram(fixtures.scored(spark, sf))


@register("dashboard_kpis", with_(SCORED) + """
SELECT count(*) AS total, count(*) FILTER (WHERE risk_score > 70) AS at_risk_count,
       coalesce(round_even(count(*) FILTER (WHERE risk_score > 70) * CAST(100.0 AS DOUBLE) / count(*) * 10, 0) / 10, 0.0) AS at_risk_pct,
       coalesce(round_even(count(*) FILTER (WHERE risk_score > 50) * CAST(100.0 AS DOUBLE) / count(*) * 10, 0) / 10, 0.0) AS avg_churn_rate,
       coalesce(round_even(avg(risk_score) * 10, 0) / 10, 0.0) AS avg_score
FROM scored""")
def dashboard_kpis(spark, sf):
    return views.dashboard_kpis(fixtures.scored(spark, sf))


_PAGE_COLS = "CustomerId, risk_score, Geography, Segment, Balance, EstimatedSalary, Age, NumOfProducts"


@register("clients_page", with_(SCORED) + f"""
SELECT {_PAGE_COLS}, (SELECT count(*) FROM scored WHERE risk_score >= 70.0001 AND risk_score < 101.0) AS total
FROM scored WHERE risk_score >= 70.0001 AND risk_score < 101.0
ORDER BY risk_score DESC, CustomerId LIMIT 25 OFFSET 10""")
def clients_page(spark, sf):
    s = fixtures.scored(spark, sf)
    ids, cols = _display(s, 6)
    f = views.filter_level(s, "eleve")
    return views.page(f.select(ids[0], "risk_score", *cols), offset=10, limit=25, id_col=ids[0])


SEARCH = "german|^1[0-9]$"


@register("clients_search", with_(SCORED) + f"""
SELECT {_PAGE_COLS}, (SELECT count(*) FROM scored WHERE
   regexp_matches(lower(CAST(Geography AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(Segment AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(Age AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(NumOfProducts AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(Balance AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(EstimatedSalary AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(CustomerId AS VARCHAR)), '{SEARCH}')) AS total
FROM scored WHERE
   regexp_matches(lower(CAST(Geography AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(Segment AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(Age AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(NumOfProducts AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(Balance AS VARCHAR)), '{SEARCH}') OR regexp_matches(lower(CAST(EstimatedSalary AS VARCHAR)), '{SEARCH}')
   OR regexp_matches(lower(CAST(CustomerId AS VARCHAR)), '{SEARCH}')
ORDER BY risk_score DESC, CustomerId LIMIT 100""")
def clients_search(spark, sf):
    s = fixtures.scored(spark, sf)
    ids, cols = _display(s, 6)
    # Search over all shown columns and the id column.
    searchable = [*cols, ids[0]]
    f = views.search(s, SEARCH, searchable)
    return views.page(f.select(ids[0], "risk_score", *cols), offset=0, limit=100, id_col=ids[0])


@register("top_risk", with_(SCORED) + """
SELECT CustomerId, risk_score, Geography, Segment, Balance, EstimatedSalary
FROM scored ORDER BY risk_score DESC, CustomerId LIMIT 10""")
def top_risk(spark, sf):
    s = fixtures.scored(spark, sf)
    ids, cols = _display(s, 4)
    return views.top_clients(s, 10, id_col=ids[0], columns=cols)


@register("high_risk_clients", with_(SCORED) + """
SELECT CustomerId, Surname, Geography, Segment, Balance, EstimatedSalary, Age, NumOfProducts, Tenure,
       IsActiveMember, Exited, risk_score, coalesce(Surname, 'Client ' || CAST(CustomerId AS VARCHAR)) AS name
FROM scored ORDER BY risk_score DESC, CustomerId LIMIT 20""")
def high_risk_clients(spark, sf):
    s = fixtures.scored(spark, sf).drop("p")
    return views.high_risk(s, 20, id_col="CustomerId", name_col="Surname")


@register("monthly_rate", """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(DISTINCT o_custkey) AS clients,
                  count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_status
           FROM orders GROUP BY 1),
r AS (SELECT *, round_even(n_status * CAST(100.0 AS DOUBLE) / n_orders * 100, 0) / 100 AS rate FROM m)
SELECT strftime(month, '%Y-%m') AS month, clients, n_orders, rate,
       round_even((rate - lag(rate) OVER (ORDER BY month)) * 100, 0) / 100 AS delta
FROM r""")
def monthly_rate(spark, sf):
    return views.monthly_rate(read_table(spark, sf, "orders"))


@register("tenure_risk_grid", with_(SCORED) + """
SELECT Tenure AS tenure, CAST(least(floor(risk_score / 10.0), 9) AS INTEGER) AS risk_bin, count(*) AS count,
       round_even(avg(risk_score) * 1000000, 0) / 1000000 AS mean_risk
FROM scored GROUP BY 1, 2""")
def tenure_risk_grid(spark, sf):
    g = views.tenure_risk_grid(fixtures.scored(spark, sf), "Tenure")
    return g.withColumn("mean_risk", F.rint(F.col("mean_risk") * 1000000) / 1000000)


@register("client_lookup", with_(SCORED) + """
SELECT CustomerId, Surname, risk_score FROM scored WHERE CustomerId = 42""")
def client_lookup(spark, sf):
    return views.lookup(fixtures.scored(spark, sf), "CustomerId", 42).select("CustomerId", "Surname", "risk_score")


@register("tenant_scores", with_(SCORED) + """,
t AS (SELECT s.*, n.n_regionkey AS tenant FROM scored s JOIN customer c ON c.c_custkey = s.CustomerId
      JOIN nation n ON c.c_nationkey = n.n_nationkey),
g AS (SELECT avg(CAST(Exited AS DOUBLE)) AS r FROM t),
m AS (SELECT tenant, ln(avg(CAST(Exited AS DOUBLE)) / (1.0 - avg(CAST(Exited AS DOUBLE)))) - (SELECT ln(r / (1.0 - r)) FROM g)
             AS shift FROM t GROUP BY tenant)
SELECT CustomerId, t.tenant,
       round_even(1.0 / (1.0 + exp(-(CAST(""" + LOGIT + """ AS DOUBLE) + m.shift))) * 100 * 10, 0) / 10 AS risk_score
FROM t JOIN m USING (tenant)""")
def tenant_scores(spark, sf):
    """Per-tenant (region) models from the registry of calibrations, one scoring pass."""
    from ..operators.score import score_by_tenant, tenant_calibration
    from ..sources.fixtures import FIXED_LOGIT_SQL
    churn = fixtures.churn(spark, sf)
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("tenant"))
    x = churn.join(cust, churn.CustomerId == cust.c_custkey).join(F.broadcast(nation),
                                                                  F.col("c_nationkey") == F.col("n_nationkey"))
    models = tenant_calibration(x, "tenant", "Exited")
    return score_by_tenant(x, "tenant", models, F.expr(FIXED_LOGIT_SQL)).select("CustomerId", "tenant", "risk_score")


@register("formatted_cells", with_(SCORED) + """,
f AS (SELECT *, chr(8239) AS sep FROM scored)
SELECT CustomerId,
       CASE WHEN Balance = floor(Balance) THEN replace(format('{:,}', CAST(floor(Balance) AS BIGINT)), ',', sep)
            ELSE printf('%.2f', Balance) END AS balance_txt,
       coalesce(CASE WHEN EstimatedSalary = floor(EstimatedSalary)
                     THEN replace(format('{:,}', CAST(floor(EstimatedSalary) AS BIGINT)), ',', sep)
                     ELSE printf('%.2f', EstimatedSalary) END, '—') AS salary_txt,
       replace(format('{:,}', Age), ',', sep) AS age_txt, coalesce(Surname, '—') AS name_txt
FROM f""")
def formatted_cells(spark, sf):
    """List-view cell text (integers as is, other floats with 2 decimals, missing as a dash)."""
    s = fixtures.scored(spark, sf)
    return s.select("CustomerId", views.format_cell("Balance", "double").alias("balance_txt"),
                    views.format_cell("EstimatedSalary", "double").alias("salary_txt"),
                    views.format_cell("Age", "bigint").alias("age_txt"),
                    views.format_cell("Surname", "string").alias("name_txt"))
