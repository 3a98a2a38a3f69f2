"""I-group queries: fallback actions, reply parsing, reuse keys, plans and mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from ..operators import recommend as I
from ..operators.rules import rule_score
from ..sources import fixtures
from ..sources.tables import read_table
from .catalog import register
from .oracle_views import DEMO, SCORED, with_
from .q_rules import score_sql

CHURN_COLUMNS = ["CustomerId", "Surname", "Geography", "Segment", "Balance", "EstimatedSalary", "Age",
                 "NumOfProducts", "Tenure", "IsActiveMember", "Exited"]
_LEVEL_SQL = "CASE WHEN risk_score > 70 THEN 'eleve' WHEN risk_score >= 30 THEN 'moyen' ELSE 'faible' END"


def _with_actions(spark, sf):
    s = fixtures.scored(spark, sf).drop("p").withColumn("risk_level", risk_level("risk_score"))
    return I.choose_actions(s, None, "CustomerId")


def _fallback_sql():
    rows = []
    for lv, (rid, action, detail, prio, impact) in I.FALLBACK.items():
        esc = lambda t: t.replace("'", "''")
        rows.append(f"('{lv}', '{rid}', '{esc(action)}', '{esc(detail)}', '{prio}', {impact})")
    return "fb(lvl, rec_id, action, detail, priority, impact) AS (VALUES " + ", ".join(rows) + ")"


_SCORED_FB = with_(SCORED, _fallback_sql()) + f""",
sc AS (SELECT *, {_LEVEL_SQL} AS risk_level FROM scored),
sa AS (SELECT sc.*, fb.rec_id, fb.action, fb.detail, fb.priority, fb.impact FROM sc JOIN fb
       ON fb.lvl = CASE WHEN risk_level = 'eleve' OR risk_score > 70 THEN 'eleve'
                        WHEN risk_level = 'moyen' OR risk_score >= 30 THEN 'moyen' ELSE 'faible' END)"""


@register("fallback_actions", _SCORED_FB + """
SELECT CustomerId, rec_id, action, priority, impact FROM sa""")
def fallback_actions(spark, sf):
    df = _with_actions(spark, sf)
    return df.select("CustomerId", F.explode("actions").alias("a")).select(
        "CustomerId", F.col("a.id").alias("rec_id"), "a.action", "a.priority", "a.impact")


@register("parse_replies", """
WITH a AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```')
             THEN trim(regexp_replace(trim(regexp_replace(t, '^```(json)?', '')), '```$', '')) ELSE t END AS t FROM a),
c AS (SELECT conv_id, turn, CASE WHEN json_valid(t) AND json_type(t) = 'ARRAY'
             THEN len(list_filter(from_json(t, '[{"action":"VARCHAR"}]'), lambda x: length(x.action) > 0)) ELSE 0 END AS n_valid
      FROM b)
SELECT conv_id, turn, n_valid, CASE WHEN n_valid > 0 THEN 'rag' ELSE 'regles_secours' END AS source FROM c""")
def parse_replies(spark, sf):
    conv = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    v = I.validate_actions(I.parse_replies("text"))
    return conv.select("conv_id", "turn", F.coalesce(F.size(v), F.lit(0)).alias("n_valid")).withColumn(
        "source", F.when(F.col("n_valid") > 0, "rag").otherwise("regles_secours"))


@register("reuse_key", with_(DEMO) + f"""
SELECT id, 'id:id=' || CAST(id AS VARCHAR) || ':score=' || CAST(CAST(round_even({score_sql()}, 0) AS BIGINT) AS VARCHAR)
       AS reuse_key FROM demo""")
def reuse_key(spark, sf):
    d = fixtures.demo_clients(spark, sf).withColumn("risk_score", rule_score().cast("double"))
    return d.select("id", I.reuse_key(d).alias("reuse_key"))


# No oracle: DuckDB's to_json prints doubles with 17 significant digits where Spark
# prints the shortest exact form, so the hashed text differs between engines.
@register("reuse_key_hash")
def reuse_key_hash(spark, sf):
    d = fixtures.demo_clients(spark, sf).withColumn("risk_score", rule_score().cast("double"))
    feats = [c for c in d.columns if c not in ("id", "risk_score")]
    return d.select("id", I.reuse_key(d.drop("id"), feature_columns=feats).alias("reuse_key"))


def _disp(c, double=False):
    if double:
        return (f"CASE WHEN {c} IS NULL THEN '' ELSE regexp_replace(regexp_replace(printf('%.2f', {c}), '0+$', ''), "
                f"'\\.$', '') END")
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def _signals_sql():
    order = ["Age", "Tenure", "Balance", "NumOfProducts", "IsActiveMember"] + \
            [c for c in CHURN_COLUMNS if c not in ("Age", "Tenure", "Balance", "NumOfProducts", "IsActiveMember")]
    items = []
    for c in order:
        d = _disp(c, c in ("Balance", "EstimatedSalary"))
        items.append(f"CASE WHEN lower(trim({d})) NOT IN ('', 'none', 'null', 'nan', 'nat') THEN '{c}: ' || {d} END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)[1:6]"


_LABEL = "CASE risk_level WHEN 'eleve' THEN 'élevé' WHEN 'moyen' THEN 'moyen' ELSE 'faible' END"
_PCT = "CAST(CAST(round_even(risk_score, 0) AS BIGINT) AS VARCHAR) || '%'"
_CAD = ("CASE risk_level WHEN 'eleve' THEN '" + I.CADENCE["eleve"].replace("'", "''") + "' WHEN 'moyen' THEN '"
        + I.CADENCE["moyen"].replace("'", "''") + "' ELSE '" + I.CADENCE["faible"].replace("'", "''") + "' END")
_IDENT = "'CustomerId ' || CAST(CustomerId AS VARCHAR)"
_STEP1 = ("'1. ' || trim(action) || CASE WHEN length(trim(detail)) > 0 THEN ' - ' || trim(detail) ELSE '' END"
          " || ' Priorité : ' || trim(priority) || '.'"
          " || CASE WHEN impact <> 0 THEN ' Impact estimé : -' || CAST(impact AS VARCHAR) || ' points de risque.' ELSE '' END")


@register("retention_plan", _SCORED_FB + f""",
p AS (SELECT CustomerId, {_IDENT} || ' présente un risque de churn ' || {_LABEL} || ' (' || {_PCT}
             || '). Le plan ci-dessous priorise les actions ' || '{I.ORIGIN["regles_secours"].replace("'", "''")}'
             || ' et les transforme en séquence opérationnelle.' AS resume,
             {_signals_sql()} AS sig, {_STEP1} AS s1, '2. ' || {_CAD} AS s2 FROM sa)
SELECT CustomerId, resume, len(sig) AS n_signals,
       resume || chr(10) || chr(10) || 'Signaux utiles:' || chr(10)
       || array_to_string(list_transform(sig, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10)
       || 'Plan d''action:' || chr(10) || s1 || chr(10) || s2 AS message
FROM p""")
def retention_plan(spark, sf):
    df = _with_actions(spark, sf)
    plan = I.retention_plan(df, signal_columns=CHURN_COLUMNS)
    return df.select("CustomerId", plan.alias("plan")).select(
        "CustomerId", "plan.resume", F.size("plan.signaux").alias("n_signals"), "plan.message")


_MAIL_ACT = "'1. ' || action || CASE WHEN length(detail) > 0 THEN ' - ' || detail ELSE '' END"


@register("alert_mail", _SCORED_FB + f""",
p AS (SELECT *, {_signals_sql()} AS sig FROM sa)
SELECT CustomerId, 'Alerte rétention - risque ' || {_LABEL} || ' (' || {_PCT} || ')' AS subject,
       'Bonjour,' || chr(10) || chr(10) || 'Service rétention signale un client avec un risque de churn ' || {_LABEL}
       || ' de ' || {_PCT} || '.' || chr(10) || 'Client concerné : ' || {_IDENT} || chr(10) || chr(10)
       || 'Signaux utiles :' || chr(10) || array_to_string(list_transform(sig, lambda x: '- ' || x), chr(10))
       || chr(10) || chr(10) || 'Plan de rétention recommandé :' || chr(10) || {_MAIL_ACT} || chr(10) || chr(10)
       || 'Prochaine étape :' || chr(10) || {_CAD} || chr(10) || chr(10)
       || 'Merci de prioriser ce suivi et de noter le retour client après contact.' || chr(10) || chr(10)
       || '-- Service rétention' AS body
FROM p""")
def alert_mail(spark, sf):
    df = _with_actions(spark, sf)
    mail = I.alert_mail(df, signal_columns=CHURN_COLUMNS)
    return df.select("CustomerId", mail.alias("m")).select("CustomerId", "m.subject", "m.body")


@register("case_file", _SCORED_FB + """
SELECT CustomerId, risk_level = 'eleve' AS escalate,
       CASE WHEN risk_level = 'eleve' THEN 'À traiter en priorité (risque élevé).'
            ELSE 'Suivi standard — pas d''action urgente.' END AS decision,
       'Risque de churn ' || risk_level || ' (' || CAST(risk_score AS VARCHAR) || '%). Actions recommandées : '
       || action || '. Décision : ' || CASE WHEN risk_level = 'eleve' THEN 'À traiter en priorité (risque élevé).'
            ELSE 'Suivi standard — pas d''action urgente.' END AS summary
FROM sa""")
def case_file(spark, sf):
    df = I.case_file(_with_actions(spark, sf))
    return df.select("CustomerId", "escalate", "decision", "summary")
