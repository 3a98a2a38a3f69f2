"""DuckDB SQL for the derived customer tables, used as CTEs by the oracle queries.

These mirror ``attrix.sources.fixtures`` and the SQL in FIXTURES.md.
"""

CHURN = """
mx AS (SELECT max(o_orderdate) AS m FROM orders),
o AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend,
             min(o_orderdate) AS first_o, max(o_orderdate) AS last_o
      FROM orders GROUP BY o_custkey),
churn AS (
  SELECT c.c_custkey AS CustomerId, c.c_name AS Surname, n.n_name AS Geography, c.c_mktsegment AS Segment,
         CASE WHEN c.c_acctbal < 0 THEN 0.0 ELSE c.c_acctbal END AS Balance,
         CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE o.spend / o.n_orders END AS EstimatedSalary,
         18 + c.c_custkey % 60 AS Age, CAST(o.n_orders AS INTEGER) AS NumOfProducts,
         CAST(floor(date_diff('day', o.first_o, m) / 365) AS INTEGER) AS Tenure,
         CASE WHEN o.last_o >= m - INTERVAL '90' DAY THEN 1 ELSE 0 END AS IsActiveMember,
         CASE WHEN o.last_o <  m - INTERVAL '180' DAY THEN 1 ELSE 0 END AS Exited
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN o ON c.c_custkey = o.o_custkey CROSS JOIN mx)"""

CHURN_DIRTY = CHURN + """,
churn_dirty AS (
  SELECT *, CAST(Exited * 10 + Age / 1000.0 AS DOUBLE) AS LeakNum,
         CASE WHEN Exited = 1 THEN 'gone' ELSE 'here' END AS LeakCat,
         CASE WHEN CustomerId % 3 = 0 THEN NULL ELSE Balance END AS ThirdNull,
         CASE WHEN CustomerId % 10 = 0 THEN 'x' END AS MostlyNull,
         CAST(7 AS DOUBLE) AS ConstNum
  FROM churn)"""

LOGIT = ("0.6 - 1.9*IsActiveMember + 0.07*(Age-47) - 0.15*(NumOfProducts-10)"
         " + CASE WHEN Segment='MACHINERY' THEN 0.8 ELSE 0.0 END - 0.0001*(Balance-4500)")

SCORED = CHURN + f""",
scored AS (
  SELECT *, round_even(p * 100 * 10, 0) / 10 AS risk_score
  FROM (SELECT *, 1.0 / (1.0 + exp(-CAST({LOGIT} AS DOUBLE))) AS p FROM churn))"""

DEMO = """
demo AS (
  SELECT c.c_custkey AS id, 1 + c.c_custkey * 7 % 71 AS tenureMonths,
         CAST(25.0 + c.c_custkey * 37 % 16500 / 100.0 AS DOUBLE) AS monthlyCharges,
         CASE c.c_custkey % 3 WHEN 0 THEN 'Mensuel' WHEN 1 THEN 'Annuel' ELSE 'Bi-annuel' END AS contract,
         1 + c.c_custkey % 5 AS products, coalesce(e.errs, 0) AS supportTickets,
         c.c_custkey * 11 % 120 AS lastInteractionDays, 1 + c.c_custkey * 5 % 6 AS satisfaction
  FROM customer c LEFT JOIN (SELECT user_id, count(*) AS errs FROM events
       WHERE event_type = 'error' GROUP BY user_id) e ON e.user_id = c.c_custkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
