"""Queries over a scored customer table.

Every aggregate here is a single global aggregate with map-side partial
aggregation (``count_if`` per bucket, then ``stack`` to rows), so a dashboard is
one scan and one tiny final exchange regardless of table size or skew. Top-N and
page queries compile to ``TakeOrderedAndProject`` (per-partition top-k, then
merge) and never sort the whole table on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LEVEL_HIGH_MIN, LEVEL_LOW_MAX, col_, fixed2, round_half_even

# Level filter ranges [lo, hi) used by the list endpoint.
LEVEL_RANGES = {"faible": (0.0, 30.0), "moyen": (30.0, 70.0001), "eleve": (70.0001, 101.0)}
# Distribution rows (label, key) in display order.
LEVEL_ROWS = (("Faible", "faible"), ("Moyen", "moyen"), ("Élevé", "eleve"))
KPI_CHURN_CUT = 50.0


def filter_level(df: DataFrame, level: str | None, score_col: str = "risk_score") -> DataFrame:
    """G1: unknown level or ``all`` means no filter."""
    if level not in LEVEL_RANGES:
        return df
    lo, hi = LEVEL_RANGES[level]
    s = F.col(score_col)
    return df.where((s >= lo) & (s < hi))


def search(df: DataFrame, query: str, columns: list[str], regex: bool = True) -> DataFrame:
    """Lower-cased containment over ``columns`` OR-ed; NULL cells never match (Q11)."""
    q = (query or "").strip().lower()
    if not q or not columns:
        return df
    conds = []
    for c in columns:
        text = F.lower(F.col(c).cast("string"))
        conds.append(F.coalesce(text.rlike(q) if regex else text.contains(q), F.lit(False)))
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return df.where(cond)


def ordered(df: DataFrame, score_col: str = "risk_score", id_col: str | None = None) -> list[Column]:
    keys = [F.col(score_col).desc()]
    if id_col:
        keys.append(F.col(id_col).asc())
    return keys


def page(df: DataFrame, offset: int = 0, limit: int = 50, score_col: str = "risk_score",
         id_col: str | None = None) -> DataFrame:
    """Sort by score desc (id tie-break), skip ``offset``, keep ``limit``.

    The total is a scalar subquery over the same filtered input, not a window over
    all rows, so it is a partial/final count and never a single-partition sort.
    """
    offset, limit = max(0, int(offset)), max(1, int(limit))
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*ordered(df, score_col, id_col)).offset(offset).limit(limit)
    return rows.withColumn("total", total)


def keyset_page(df: DataFrame, after_score: float | None, after_id, limit: int = 50,
                score_col: str = "risk_score", id_col: str = "id") -> DataFrame:
    """Deep pages: continue after the last (score, id) seen instead of skipping rows."""
    if after_score is not None:
        s, i = F.col(score_col), F.col(id_col)
        df = df.where((s < after_score) | ((s == after_score) & (i > F.lit(after_id))))
    return df.orderBy(*ordered(df, score_col, id_col)).limit(max(1, int(limit)))


def display_columns(columns: list[str], id_cols: list[str], target: str | None, n: int,
                    score_col: str = "risk_score") -> list[str]:
    """Drop identifiers, target and score; keep the first ``n``."""
    excluded = set(id_cols) | {target, score_col}
    return [c for c in columns if c not in excluded][:n]


def row_shape(df: DataFrame, id_col: str | None, columns: list[str], score_col: str = "risk_score") -> DataFrame:
    """``{id, risk_score, values{}}`` rows; values as a string map, NULL kept as NULL."""
    rid = F.col(id_col).cast("string") if id_col else F.xxhash64(*[F.col(c) for c in columns]).cast("string")
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                               F.array(*[F.col(c).cast("string") for c in columns]))
    return df.select(rid.alias("id"), F.col(score_col).alias("risk_score"), values.alias("values"))


def risk_distribution(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """Three rows (Faible, Moyen, Élevé), always present, from one global aggregate."""
    s = F.col(score_col)
    counts = df.agg(F.count_if(s < LEVEL_LOW_MAX).alias("faible"),
                    F.count(F.lit(1)).alias("total"),
                    F.count_if(s > LEVEL_HIGH_MIN).alias("eleve"))
    counts = counts.withColumn("moyen", F.col("total") - F.col("faible") - F.col("eleve"))
    stack = ", ".join(f"'{label}', '{key}', `{key}`" for label, key in LEVEL_ROWS)
    return counts.selectExpr(f"stack(3, {stack}) as (level, key, count)")


def risk_histogram(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """10 bins [b, b+10), the last one [90, 100.1); empty bins kept."""
    s = F.col(score_col)
    aggs = []
    for b in range(0, 100, 10):
        hi = b + 10 if b < 90 else 100.1
        aggs.append(F.count_if((s >= b) & (s < hi)).alias(f"b{b}"))
    counts = df.agg(*aggs)
    stack = ", ".join(f"{b // 10}, '{b}–{b + 10}', b{b}" for b in range(0, 100, 10))
    return counts.selectExpr(f"stack(10, {stack}) as (bin, tranche, count)")


def dashboard_kpis(df: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """Total, at-risk count and %, predicted churn % (score > 50), mean score; 0.0 on empty."""
    s = F.col(score_col)
    agg = df.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(s > LEVEL_HIGH_MIN).alias("at_risk_count"),
                 F.count_if(s > KPI_CHURN_CUT).alias("churners"),
                 F.avg(s).alias("mean_score"))
    pct = lambda n: F.coalesce(round_half_even(F.try_divide(F.col(n) * 100.0, F.col("total")), 1), F.lit(0.0))
    return agg.select(
        "total", "at_risk_count",
        pct("at_risk_count").alias("at_risk_pct"),
        pct("churners").alias("avg_churn_rate"),
        F.coalesce(round_half_even("mean_score", 1), F.lit(0.0)).alias("avg_score"))


def top_clients(df: DataFrame, n: int = 10, score_col: str = "risk_score", id_col: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Top-n by score (TakeOrderedAndProject)."""
    cols = ([id_col] if id_col else []) + [score_col] + list(columns or [])
    return df.orderBy(*ordered(df, score_col, id_col)).limit(n).select(*cols)


def high_risk(df: DataFrame, n: int = 20, score_col: str = "risk_score", id_col: str = "CustomerId",
              name_col: str | None = "Surname") -> DataFrame:
    """Top-n with all columns; display name = name column or ``Client <id>``."""
    fallback = F.concat(F.lit("Client "), F.col(id_col).cast("string"))
    name = F.coalesce(F.col(name_col).cast("string"), fallback) if name_col in df.columns else fallback
    return df.orderBy(*ordered(df, score_col, id_col)).limit(n).withColumn("name", name)


def empty_like(df: DataFrame) -> DataFrame:
    """Empty result with the right schema (no model yet)."""
    return df.limit(0)


def monthly_rate(orders: DataFrame, date_col: str = "o_orderdate", status_col: str = "o_orderstatus",
                 status: str = "F", cust_col: str = "o_custkey") -> DataFrame:
    """G13 on real data: per month, active clients, share of orders in ``status`` and its change.

    The ``lag`` window runs over the already aggregated month rows (one row per
    month), never over the raw table.
    """
    m = (orders.groupBy(F.date_trunc("month", F.col(date_col)).alias("month"))
         .agg(F.count_distinct(cust_col).alias("clients"),
              F.count(F.lit(1)).alias("n_orders"),
              F.count_if(F.col(status_col) == status).alias("n_status")))
    rate = round_half_even(F.col("n_status") * 100.0 / F.col("n_orders"), 2)
    m = m.withColumn("rate", rate)
    w = Window.orderBy("month")
    return m.select(F.date_format("month", "yyyy-MM").alias("month"), "clients", "n_orders", "rate",
                    round_half_even(F.col("rate") - F.lag("rate").over(w), 2).alias("delta"))


def tenure_scatter(df: DataFrame, tenure_col: str, score_col: str = "risk_score", name_col: str | None = None) -> DataFrame:
    """(tenure, risk, name) pairs."""
    cols = [F.col(tenure_col).alias("tenure"), F.col(score_col).alias("risk")]
    if name_col:
        cols.append(F.col(name_col).alias("name"))
    return df.select(*cols)


def tenure_risk_grid(df: DataFrame, tenure_col: str, score_col: str = "risk_score",
                     score_bin: float = 10.0) -> DataFrame:
    """G14 for large tables: 2-D binned counts instead of one point per client."""
    return (df.groupBy(F.col(tenure_col).alias("tenure"),
                       F.least(F.floor(F.col(score_col) / score_bin), F.lit(int(100 / score_bin) - 1)).cast("int").alias("risk_bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(score_col).alias("mean_risk")))


def lookup(df: DataFrame, id_col: str, value) -> DataFrame:
    """One client by id (pushed down to the scan when ``df`` is a table)."""
    return df.where(F.col(id_col) == F.lit(value))


def format_cell(c, data_type: str) -> Column:
    """Integral numbers with fr-FR digit grouping (narrow no-break space, as
    ``toLocaleString('fr-FR')``), other floats with 2 decimals, missing as an em dash."""
    c = col_(c)
    grouped = F.regexp_replace(F.format_number(c, 0), ",", "\u202f")
    if data_type in ("double", "float"):
        txt = F.when(c == F.floor(c), grouped).otherwise(fixed2(c))
    elif data_type in ("int", "bigint", "smallint", "tinyint", "long"):
        txt = grouped
    else:
        txt = c.cast("string")
    return F.when(c.isNull(), F.lit("—")).otherwise(txt)