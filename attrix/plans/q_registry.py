"""J-group queries (and A16) over a registry derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as J
from ..sources import fixtures
from .catalog import register

_REG_SQL = """
WITH cust AS (SELECT c.c_custkey, lower(c.c_name) AS username, c.c_name AS full_name,
                     CAST(n.n_regionkey AS INTEGER) AS region, c.c_acctbal, c.c_mktsegment
              FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
users AS (SELECT username, full_name, region AS organisation_id,
                 CASE WHEN c_custkey % 50 = 1 THEN 'admin' ELSE 'operateur' END AS role FROM cust),
versions AS (SELECT strftime(o.o_orderdate, '%Y%m%dT%H%M%S') || '_' || CAST(o.o_orderkey AS VARCHAR) AS version,
                    o.o_orderdate AS ts, c.username,
                    CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.region END AS organisation_id,
                    CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Exited' WHEN 'AUTOMOBILE' THEN 'Attrition' ELSE 'Churn' END AS target,
                    lower(c.c_mktsegment) || '_clients.csv' AS dataset, o.o_orderpriority AS algorithm,
                    ['f', substr(o.o_orderpriority, 1, 1)] AS features, o.o_orderstatus AS status
             FROM orders o JOIN cust c ON o.o_custkey = c.c_custkey),
activations AS (SELECT username AS scope, version, ts + INTERVAL 1 DAY AS ts FROM versions WHERE status = 'F'),
cur AS (SELECT scope, arg_max(version, (ts, version)) AS version FROM activations GROUP BY scope)"""

_LABEL_SQL = """coalesce(CASE target WHEN 'Exited' THEN 'Banque - Churn client' WHEN 'Attrition' THEN 'RH - Depart employe' END,
   CASE WHEN length(trim(regexp_replace(regexp_replace(trim(dataset), '\\.[^.]*$', ''), '[_-]', ' ', 'g'))) > 0 THEN
     (SELECT array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(trim(dataset), '\\.[^.]*$', ''), '[_-]', ' ', 'g')), ' '),
         lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' '))
     || CASE WHEN length(trim(target)) > 0 THEN ' (' || target || ')' ELSE '' END END,
   CASE WHEN length(trim(target)) > 0 THEN 'Prediction ' || target ELSE 'Modele' END)"""

# The catalogue is viewed by the first admin (lowest customer key with the admin role).
VIEWER_SQL = "(SELECT min_by(organisation_id, username) FROM users WHERE role = 'admin' AND username = (SELECT min(username) FROM users WHERE role = 'admin'))"


def _viewer(users):
    r = users.where(F.col("role") == "admin").orderBy("username").limit(1).first()
    return {"username": r["username"], "organisation_id": r["organisation_id"], "role": "admin"}


@register("current_versions", _REG_SQL + "\nSELECT scope, version FROM cur")
def current_versions(spark, sf):
    _, _, acts, _ = fixtures.registry_tables(spark, sf)
    return J.current_versions(acts)


@register("model_catalogue", _REG_SQL + f""",
vw AS (SELECT min(username) AS vname FROM users WHERE role = 'admin'),
vo AS (SELECT organisation_id AS vorg, vname FROM users, vw WHERE username = vname),
act AS (SELECT version AS av FROM cur, vw WHERE scope = vname)
SELECT v.version, {_LABEL_SQL} AS label, v.target, v.algorithm, len(v.features) AS n_features, v.ts,
       coalesce(v.version = (SELECT av FROM act), false) AS active, v.username, u.full_name AS owner_name
FROM versions v CROSS JOIN vo
LEFT JOIN users u ON u.username = v.username AND u.organisation_id = vo.vorg
WHERE v.organisation_id IS NULL OR v.organisation_id = vo.vorg""")
def model_catalogue(spark, sf):
    users, versions, acts, _ = fixtures.registry_tables(spark, sf)
    viewer = _viewer(users)
    cur = J.current_versions(acts).where(F.col("scope") == viewer["username"]).first()
    return J.catalogue(versions, users, cur["version"] if cur else None, viewer)


@register("latest_per_owner", _REG_SQL + f""",
cat AS (SELECT v.version, {_LABEL_SQL} AS label, v.username, coalesce(c.version IS NOT NULL, false) AS active
        FROM versions v LEFT JOIN cur c ON c.scope = v.username AND c.version = v.version)
SELECT username, label, arg_max(version, (CAST(active AS INTEGER), version)) AS version FROM cat GROUP BY 1, 2""")
def latest_per_owner(spark, sf):
    users, versions, acts, _ = fixtures.registry_tables(spark, sf)
    cur = J.current_versions(acts)
    cat = versions.join(cur.select(F.col("scope").alias("username"), "version", F.lit(True).alias("active")),
                        ["username", "version"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
    cat = cat.withColumn("label", J.model_label(F.col("target"), F.col("dataset")))
    return J.latest_per_owner_label(cat)


@register("delete_versions", _REG_SQL + """,
req AS (SELECT version FROM versions WHERE status = 'P'
        UNION SELECT version FROM cur
        UNION SELECT 'missing_' || version FROM versions WHERE status = 'O' AND algorithm = '1-URGENT')
SELECT r.version, CASE WHEN NOT EXISTS (SELECT 1 FROM versions v WHERE v.version = r.version) THEN 'not_found'
                       WHEN EXISTS (SELECT 1 FROM cur c WHERE c.version = r.version) THEN 'refused_active'
                       ELSE 'deleted' END AS outcome
FROM req r""")
def delete_versions(spark, sf):
    _, versions, acts, status = fixtures.registry_tables(spark, sf)
    cur = J.current_versions(acts)
    req = (status.where(F.col("status") == "P").select("version")
           .unionByName(cur.select("version"))
           .unionByName(versions.join(status, "version").where((F.col("status") == "O") & (F.col("algorithm") == "1-URGENT"))
                        .select(F.concat(F.lit("missing_"), F.col("version")).alias("version"))))
    return J.delete_versions(req, versions, cur)


@register("backfill_active", _REG_SQL + """
SELECT username AS scope, max(version) AS version FROM versions
WHERE username NOT IN (SELECT scope FROM cur) GROUP BY username""")
def backfill_active(spark, sf):
    _, versions, acts, _ = fixtures.registry_tables(spark, sf)
    return J.backfill_active(versions, J.current_versions(acts))


@register("append_unseen", _REG_SQL + """,
existing AS (SELECT username FROM cust WHERE c_mktsegment = 'BUILDING')
SELECT CASE WHEN username IN (SELECT username FROM existing) THEN 'skipped' ELSE 'migrated' END AS status,
       count(*) AS n FROM users GROUP BY 1""")
def append_unseen(spark, sf):
    users, _, _, _ = fixtures.registry_tables(spark, sf)
    from ..sources.tables import read_table
    existing = read_table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.lower("c_name").alias("username"))
    _, counts = J.append_unseen(users, existing, "username")
    return counts


@register("register_and_activate")
def register_and_activate(spark, sf):
    """J1-J3 + D19 + D20: train on the customer table, log the run, register the winner
    (model files then version row), activate it, and list the registry newest first."""
    from ..operators import train as T
    from ..sources.files import scratch_path
    churn = fixtures.churn(spark, sf)
    res = T.train_and_select(churn, "Exited", "CustomerId", ids=["CustomerId", "Surname"], leaks=[],
                             models=["Naive Bayes"], folds=3)
    root = scratch_path(spark, "registry")
    T.log_runs(spark, root, res.leaderboard, "churn", {"folds": 3})
    meta = {"username": "operator", "organisation_id": 1, "target": "Exited", "dataset": "churn.parquet",
            "algorithm": res.best_name, "features": [c for c in churn.columns if c not in ("CustomerId", "Surname", "Exited")],
            "classes": ["0", "1"], "reason": res.reason}
    version = J.register_version(spark, root, res.model, meta, activate_scope="operator")
    versions = spark.read.parquet(f"{root}/versions")
    current = J.current_versions(spark.read.parquet(f"{root}/activations"))
    runs = spark.read.parquet(f"{root}/runs")
    listing = J.list_versions(versions).join(current.withColumnRenamed("scope", "active_scope"), "version", "left")
    return listing.select("version", "algorithm", F.size("features").alias("n_features"), "active_scope",
                          J.model_label(F.col("target"), F.col("dataset")).alias("label"),
                          F.lit(runs.count()).alias("logged_models"), F.lit(version).alias("registered"))


@register("registry_commits", _REG_SQL + """,
left_over AS (SELECT * FROM versions WHERE status <> 'P' OR version IN (SELECT version FROM cur)),
now AS (SELECT scope, version FROM cur
        UNION ALL SELECT username, max(version) FROM left_over WHERE username NOT IN (SELECT scope FROM cur) GROUP BY username)
SELECT scope, n.version, count(*) AS n_versions FROM now n JOIN left_over v ON v.username = n.scope GROUP BY scope, n.version""")
def registry_commits(spark, sf):
    """J1-J5, J10 as commits: versions registered, activated, pending ones deleted, owners without an active one backfilled."""
    from ..operators.registry_log import Registry
    from ..sources.files import scratch_path
    _, versions, acts, status = fixtures.registry_tables(spark, sf)
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.register(versions.withColumns({"classes": F.array(F.lit("0"), F.lit("1")), "reason": F.lit(None).cast("string"),
                                            "model_path": F.lit(None).cast("string"), "ts": F.col("ts").cast("timestamp")}))
    registry.activate(acts.withColumn("ts", F.col("ts").cast("timestamp")))
    registry.delete(status.where(F.col("status") == "P").select("version"))
    registry.backfill()
    s = registry.snapshot()
    owned = s.versions().groupBy(F.col("username").alias("scope")).agg(F.count(F.lit(1)).alias("n_versions"))
    return s.current().join(owned, "scope").select("scope", "version", "n_versions")
