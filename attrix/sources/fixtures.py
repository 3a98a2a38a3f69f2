"""Customer tables derived from the star schema (see FIXTURES.md).

``churn``        one row per customer with bank-style features and a 0/1 target.
``churn_dirty``  ``churn`` plus leak, missing and constant columns for profiling.
``scored``       ``churn`` scored by the fixed logistic scorer.
``demo_clients`` the 15-field demo client shape used by the rule operators.

All of them are lazy DataFrames over the parquet tables: the per-customer order
aggregate is a partial/final hash aggregate on ``o_custkey`` and the customer join
reuses that partitioning; ``nation`` is a fixed 25-row dimension and is the only
broadcast side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    # Scalar subquery (one value, planned as a separate job) instead of a cross join.
    last_day = orders.select(F.max("o_orderdate")).scalar()
    per_cust = (orders.groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders"),
                     F.sum("o_totalprice").alias("spend"),
                     F.min("o_orderdate").alias("first_o"),
                     F.max("o_orderdate").alias("last_o")))
    key = F.col("c_custkey")
    return (customer
            .join(F.broadcast(nation.select("n_nationkey", "n_name")),
                  customer.c_nationkey == nation.n_nationkey)
            .join(per_cust, key == per_cust.o_custkey)
            .select(
                key.alias("CustomerId"),
                F.col("c_name").alias("Surname"),
                F.col("n_name").alias("Geography"),
                F.col("c_mktsegment").alias("Segment"),
                F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("Balance"),
                F.when(key % 17 == 0, F.lit(None).cast("double"))
                 .otherwise(F.col("spend") / F.col("n_orders")).alias("EstimatedSalary"),
                (F.lit(18) + key % 60).alias("Age"),
                F.col("n_orders").cast("int").alias("NumOfProducts"),
                F.floor(F.datediff(last_day, F.col("first_o")) / 365).cast("int").alias("Tenure"),
                F.when(F.col("last_o") >= last_day - F.expr("INTERVAL 90 DAYS"), 1).otherwise(0).alias("IsActiveMember"),
                F.when(F.col("last_o") < last_day - F.expr("INTERVAL 180 DAYS"), 1).otherwise(0).alias("Exited"),
            ))


def churn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn(spark, sf_dir).withColumns({
        "LeakNum": F.expr("cast(Exited * 10 + Age / 1000.0 as double)"),
        "LeakCat": F.when(F.col("Exited") == 1, "gone").otherwise("here"),
        "ThirdNull": F.when(F.col("CustomerId") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("Balance")),
        "MostlyNull": F.when(F.col("CustomerId") % 10 == 0, F.lit("x")),
        "ConstNum": F.lit(7.0),
    })


# Coefficients of the reference logistic scorer (FIXTURES.md §3),
# written as SQL so that decimal literals evaluate exactly as in the oracle.
FIXED_LOGIT_SQL = ("0.6 - 1.9*IsActiveMember + 0.07*(Age-47) - 0.15*(NumOfProducts-10)"
                   " + case when Segment='MACHINERY' then 0.8 else 0.0 end"
                   " - 0.0001*(Balance-4500)")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.score import logistic_probability, risk_score
    df = churn(spark, sf_dir)
    df = df.withColumn("p", logistic_probability(F.expr(FIXED_LOGIT_SQL)))
    return df.withColumn("risk_score", risk_score(F.col("p")))


def demo_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    events = read_table(spark, sf_dir, "events")
    errs = (events.where(F.col("event_type") == "error")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("errs")))
    return (customer.join(errs, customer.c_custkey == errs.user_id, "left")
            .select(
                F.col("c_custkey").alias("id"),
                F.expr("1 + c_custkey * 7 % 71").alias("tenureMonths"),
                F.expr("cast(25.0 + c_custkey * 37 % 16500 / 100.0 as double)").alias("monthlyCharges"),
                F.expr("case c_custkey % 3 when 0 then 'Mensuel' when 1 then 'Annuel' else 'Bi-annuel' end").alias("contract"),
                F.expr("1 + c_custkey % 5").alias("products"),
                F.coalesce(F.col("errs"), F.lit(0)).alias("supportTickets"),
                F.expr("c_custkey * 11 % 120").alias("lastInteractionDays"),
                F.expr("1 + c_custkey * 5 % 6").alias("satisfaction"),
            ))


def order_drift_split(spark: SparkSession, sf_dir: str, cutoff: str = "1999-01-01"):
    """Reference (before cutoff) and new (from cutoff) order samples for drift (H)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    ref = orders.where(F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz")).drop("o_orderdate")
    new = orders.where(F.col("o_orderdate") >= F.lit(cutoff).cast("timestamp_ntz")).drop("o_orderdate")
    return ref, new


def registry_tables(spark: SparkSession, sf_dir: str):
    """Registry state derived from the star schema (see ``plans/q_registry``):

    users       one per customer: username, full name, organisation (region), role;
    versions    one model version per order, owned by the ordering customer;
    activations one per fulfilled order ('F'), one day after its registration.
    """
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    orders = read_table(spark, sf_dir, "orders")
    cust = (customer.join(F.broadcast(nation.select("n_nationkey", "n_regionkey")),
                          customer.c_nationkey == nation.n_nationkey)
            .select("c_custkey", F.lower("c_name").alias("username"), F.col("c_name").alias("full_name"),
                    F.col("n_regionkey").cast("int").alias("region"), "c_acctbal", "c_mktsegment"))
    users = cust.select("username", "full_name", F.col("region").alias("organisation_id"),
                        F.when(F.col("c_custkey") % 50 == 1, "admin").otherwise("operateur").alias("role"))
    target = (F.when(F.col("c_mktsegment") == "BUILDING", "Exited")
              .when(F.col("c_mktsegment") == "AUTOMOBILE", "Attrition").otherwise("Churn"))
    versions = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.col("o_orderkey").cast("string"))
        .alias("version"),
        F.col("o_orderdate").alias("ts"), "username",
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("int")).otherwise(F.col("region")).alias("organisation_id"),
        target.alias("target"),
        F.concat(F.lower("c_mktsegment"), F.lit("_clients.csv")).alias("dataset"),
        F.col("o_orderpriority").alias("algorithm"),
        F.split(F.concat_ws(",", F.lit("f"), F.substring("o_orderpriority", 1, 1)), ",").alias("features"),
        F.col("o_orderstatus").alias("status"))
    activations = versions.where(F.col("status") == "F").select(
        F.col("username").alias("scope"), "version", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    return users, versions.drop("status"), activations, versions.select("version", "status")
