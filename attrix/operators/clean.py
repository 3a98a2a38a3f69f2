"""Cleaning and feature derivation.

Statistics are computed in at most two aggregation passes (medians/modes, then
quartiles of the imputed data); applying them is a projection, so a cleaned
table is one extra scan and never a join or a row-order dependent operation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import is_numeric_kind, kind
from .stats import modes, quantiles

IQR_FACTOR = 1.5
IMBALANCE_THRESHOLD = 1.5


def drop_unused(df: DataFrame, ids: list[str], leaks: list[str], target: str | None) -> DataFrame:
    """Drop identifier and leak columns, keep the target."""
    drop = [c for c in set(ids) | set(leaks) if c in df.columns and c != target]
    return df.drop(*drop)


@dataclass
class ImputeStats:
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def fit_imputer(df: DataFrame, target: str | None) -> ImputeStats:
    """Median for numeric columns with nulls, mode for the others; target untouched."""
    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    with_nulls = [c for c in df.columns if c != target and nulls[c] > 0]
    num = [c for c in with_nulls if is_numeric_kind(kinds[c])]
    cat = [c for c in with_nulls if not is_numeric_kind(kinds[c])]
    q = quantiles(df, num, [0.5])
    return ImputeStats(medians={c: v[0][0] for c, v in q.items() if v[0] is not None},
                       modes={c: m for c, m in modes(df, cat).items() if m is not None})


def apply_imputer(df: DataFrame, st: ImputeStats) -> DataFrame:
    repl = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in st.medians.items()}
    repl.update({c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c])) for c, v in st.modes.items()})
    return df.withColumns(repl) if repl else df


@dataclass
class ClipBounds:
    bounds: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)  # q1, q3, lo, hi


def fit_clipper(df: DataFrame, target: str | None, factor: float = IQR_FACTOR) -> ClipBounds:
    """C4: IQR bounds for numeric columns (not bool, not target, >2 distinct, IQR > 0)."""
    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    cand = [c for c in df.columns if c != target and kinds[c] in ("int", "float")]
    if not cand:
        return ClipBounds()
    nd = df.agg(*[F.count_distinct(c).alias(c) for c in cand]).first().asDict()
    cand = [c for c in cand if nd[c] > 2]
    q = quantiles(df, cand, [0.25, 0.75])
    out = {}
    for c in cand:
        vals = q[c][0]
        if vals is None:
            continue
        q1, q3 = vals
        iqr = q3 - q1
        if iqr <= 0:
            continue
        out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return ClipBounds(out)


def apply_clipper(df: DataFrame, cb: ClipBounds) -> DataFrame:
    """Clip to [lo, hi]; NULL stays NULL and no row is removed."""
    repl = {c: F.when(F.col(c).isNull(), F.lit(None).cast("double"))
            .otherwise(F.greatest(F.least(F.col(c).cast("double"), F.lit(hi)), F.lit(lo)))
            for c, (_, _, lo, hi) in cb.bounds.items()}
    return df.withColumns(repl) if repl else df


def clean(df: DataFrame, ids: list[str], leaks: list[str], target: str | None,
          clip_outliers: bool = True) -> DataFrame:
    """Drop -> impute -> clip (quartiles taken after imputation)."""
    out = drop_unused(df, ids, leaks, target)
    out = apply_imputer(out, fit_imputer(out, target))
    if clip_outliers:
        out = apply_clipper(out, fit_clipper(out, target))
    return out


def add_features(df: DataFrame) -> DataFrame:
    """Derived features, each only when its source columns exist."""
    cols = set(df.columns)
    new = {}
    if "Balance" in cols:
        new["SoldeNul"] = F.coalesce(F.col("Balance") == 0, F.lit(False)).cast("int")
    if {"Balance", "EstimatedSalary"} <= cols:
        new["RatioSoldeSalaire"] = F.try_divide(F.col("Balance"), F.abs(F.col("EstimatedSalary")) + 1.0)
    if {"Age", "Tenure"} <= cols:
        new["AncienneteRatioAge"] = F.try_divide(F.col("Tenure"), F.col("Age") + 1.0)
    if {"NumOfProducts", "Tenure"} <= cols:
        new["ProduitsParAnciennete"] = F.try_divide(F.col("NumOfProducts"), F.col("Tenure") + 1.0)
    return df.withColumns(new) if new else df


def split_columns(df: DataFrame, target: str | None) -> tuple[list[str], list[str]]:
    """C11: predictors split into numeric (bool included) and non-numeric."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        (num if is_numeric_kind(kind(f.dataType)) else cat).append(f.name)
    return num, cat


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, target: str, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """max/min class count (1.0 with fewer than 2 classes) and the >= 1.5 flag."""
    c = class_counts(df, target).agg(F.max("n").alias("mx"), F.min("n").alias("mn"),
                                     F.count(F.lit(1)).alias("k"))
    ratio = F.when(F.col("k") < 2, F.lit(1.0)).otherwise(F.col("mx") / F.col("mn"))
    return c.select(F.col("k").alias("n_classes"), (F.rint(ratio * 1000000) / 1000000).alias("ratio"),
                    (ratio >= threshold).alias("imbalanced"))


def encode_target(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Adds ``label``, the index of the target's value among its two sorted values (numbers, booleans or text).

    Any other number of classes is refused before anything is collected (Q14, D20).
    """
    value = F.col(target) if dict(df.dtypes)[target] != "boolean" else F.col(target).cast("int")
    seen = df.where(value.isNotNull()).select(value.alias("v")).distinct().orderBy("v").limit(3).collect()
    if not seen:
        raise ValueError(f"no row has a value of {target}")
    if len(seen) != 2:
        raise ValueError(f"{target} must have two classes; it has {'one' if len(seen) == 1 else 'more'}")
    low, high = seen[0]["v"], seen[1]["v"]
    return df.withColumn("label", F.when(value == F.lit(high), 1).when(value == F.lit(low), 0)), [str(low), str(high)]
