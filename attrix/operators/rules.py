"""Rule-based scoring on the demo client shape.

Everything is a per-row column expression: contributions and actions are built as
arrays of structs, ordered with ``array_sort`` and cut with ``slice`` inside the
row, so none of these operators shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score adjustment per contract type.
CONTRACT_ADJ = {"Mensuel": 22.0, "Annuel": -6.0, "Bi-annuel": -14.0}


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(x + 0.5)


def _contract_adj(contract: Column) -> Column:
    e = F.lit(None).cast("double")
    for k, v in reversed(list(CONTRACT_ADJ.items())):
        e = F.when(contract == k, F.lit(v)).otherwise(e)
    return e


def rule_score(tenure="tenureMonths", contract="contract", tickets="supportTickets",
               last="lastInteractionDays", satisfaction="satisfaction", products="products",
               charges="monthlyCharges") -> Column:
    """32 + tenure + contract + tickets + inactivity + satisfaction + products + charges;
    clamp to [3, 98], rounded half-up. Terms are added in this order (float steps matter)."""
    c = lambda n: F.col(n) if isinstance(n, str) else n
    s = F.lit(32.0)
    s = s + F.greatest(F.lit(0), F.lit(24) - c(tenure)) * 1.1
    s = s + _contract_adj(c(contract))
    s = s + c(tickets) * 2.4
    s = s + F.greatest(F.lit(0), c(last) - 30) * 0.35
    s = s + (F.lit(7) - c(satisfaction)) * 4
    s = s + (F.lit(4) - c(products)) * 3
    s = s + F.when(c(charges) > 120, F.lit(6.0)).otherwise(F.lit(0.0))
    return js_round(F.least(F.lit(98.0), F.greatest(F.lit(3.0), s))).cast("int")


# Rule contributions (feature key, label) in display order.
CONTRIBUTION_FEATURES = (("contract", "Type de contrat"), ("satisfaction", "Score de satisfaction"),
                         ("support_tickets", "Tickets support (90j)"), ("tenure", "Ancienneté"),
                         ("last_interaction", "Dernière interaction"), ("products", "Produits souscrits"))


def rule_contributions(df: DataFrame, top: int = 5) -> Column:
    """R2: six rule contributions, top ``top`` by |contribution| (ties keep display order)."""
    vals = [
        _contract_adj(F.col("contract")),
        js_round((F.lit(7) - F.col("satisfaction")) * 4 - 6),
        js_round(F.col("supportTickets") * 2.4 - 6),
        js_round(F.greatest(F.lit(0), F.lit(24) - F.col("tenureMonths")) * 1.1 - 8),
        js_round(F.greatest(F.lit(0), F.col("lastInteractionDays") - 30) * 0.35 - 4),
        js_round((F.lit(4) - F.col("products")) * 3 - 3),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("feature"), F.lit(lbl).alias("label"),
                               v.cast("int").alias("contribution"))
                      for i, ((k, lbl), v) in enumerate(zip(CONTRIBUTION_FEATURES, vals))])
    ranked = F.array_sort(items, lambda a, b: F.when(F.abs(a.contribution) > F.abs(b.contribution), -1)
                          .when(F.abs(a.contribution) < F.abs(b.contribution), 1)
                          .otherwise(a.ord - b.ord))
    return F.slice(ranked, 1, top)


# Rule actions (id, action, detail, impact, priority) and their conditions.
RULE_ACTIONS = (
    ("r-contract", "Proposer une offre annuelle avec remise",
     "Convertir le contrat mensuel en engagement annuel (-15%).", 18, "Haute"),
    ("r-csm", "Appel de suivi par un Customer Success Manager",
     "Prise de contact personnalisée pour résoudre les irritants.", 14, "Haute"),
    ("r-support", "Escalade prioritaire des tickets ouverts",
     "Assigner un référent technique dédié pour clôturer les incidents.", 11, "Moyenne"),
    ("r-reengage", "Campagne de ré-engagement",
     "Séquence e-mail + démo des fonctionnalités non utilisées.", 9, "Moyenne"),
    ("r-crosssell", "Cross-sell d'un module complémentaire",
     "Augmenter l'ancrage produit avec une offre pertinente.", 7, "Basse"),
)
RULE_DEFAULT = ("r-monitor", "Maintenir le suivi standard",
                "Client sain — surveiller les signaux faibles trimestriellement.", 3, "Basse")


def _action_struct(a) -> Column:
    rid, action, detail, impact, prio = a
    return F.struct(F.lit(rid).alias("id"), F.lit(action).alias("action"), F.lit(detail).alias("detail"),
                    F.lit(impact).alias("impact"), F.lit(prio).alias("priority"))


def rule_actions() -> Column:
    """Actions whose condition holds, in rule order; a default action when none does."""
    conds = [F.col("contract") == "Mensuel", F.col("satisfaction") <= 3, F.col("supportTickets") >= 5,
             F.col("lastInteractionDays") > 45, F.col("products") < 3]
    arr = F.filter(F.array(*[F.when(c, _action_struct(a)) for c, a in zip(conds, RULE_ACTIONS)]),
                   lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(_action_struct(RULE_DEFAULT)))


# What-if variables (key, label, min, max, step).
WHAT_IF_VARIABLES = (("satisfaction", "Score de satisfaction", 1, 6, 1),
                     ("supportTickets", "Tickets support", 0, 15, 1),
                     ("lastInteractionDays", "Jours depuis interaction", 0, 120, 1),
                     ("products", "Produits souscrits", 1, 6, 1))


def demo_dashboard_kpis(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """The demo dashboard KPIs over the rule-scored client table: total, at-risk
    count (level eleve: score > 70), at-risk % and predicted-churn % (score > 50)
    rounded with Math.round to 0.1, mean score likewise; one global aggregate."""
    s = F.col(score_col)
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(s > 70).alias("at_risk_count"),
                 F.count_if(s > 50).alias("churners"), F.sum(s).alias("__sum"))
    share = lambda n: js_round(F.try_divide(F.col(n) * 1.0, F.col("total")) * 1000) / 10
    return agg.select(
        "total", "at_risk_count", share("at_risk_count").alias("at_risk_pct"),
        share("churners").alias("avg_churn_rate"),
        (js_round(F.coalesce(F.col("__sum"), F.lit(0)) / F.greatest(F.col("total"), F.lit(1)) * 10) / 10)
        .alias("avg_score"))


def rule_what_if(df: DataFrame, scenarios: list[tuple[str, dict]]) -> DataFrame:
    """Re-score each client under each scenario (overrides of the five inputs).

    Scenarios are the caller's parameter list; they are attached per row with an
    ``explode`` of a literal array (a generator, not a join), so the output is
    exactly rows x scenarios. Override values are Column expressions and may read
    the row (e.g. ``products + 1``).
    """
    keys = ("satisfaction", "supportTickets", "lastInteractionDays", "products", "contract")
    items = []
    for name, ov in scenarios:
        fields = [F.lit(name).alias("scenario")]
        for k in keys:
            v = ov.get(k, F.col(k))
            v = v if isinstance(v, Column) else F.lit(v)
            fields.append(v.cast(dict(df.dtypes)[k]).alias(k))
        items.append(F.struct(*fields))
    base = rule_score()
    x = df.withColumn("base_score", base).withColumn("sc", F.explode(F.array(*items)))
    new = rule_score(contract=F.col("sc.contract"), tickets=F.col("sc.supportTickets"),
                     last=F.col("sc.lastInteractionDays"), satisfaction=F.col("sc.satisfaction"),
                     products=F.col("sc.products"))
    return x.select("id", F.col("sc.scenario").alias("scenario"), "base_score", new.alias("new_score"),
                    (new - F.col("base_score")).alias("delta"))
