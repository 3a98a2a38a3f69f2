"""Exact k-nearest neighbours without an all-pairs join (D12 k-NN, C18 SMOTE).

Reference points are first collapsed to distinct vectors with a multiplicity (a vector repeated by a third of the rows is
one row with a large count); the search itself is in ``boxes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import nearest


def _vec(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def knn(queries: DataFrame, refs: DataFrame, features: list[str], k: int, qid: str, rid: str,
        label: str | None = None, exclude_self: bool = False, target_per_cell: int = 32) -> DataFrame:
    """Exact k nearest reference points of every query.

    Returns ``(qid, neighbours)`` where ``neighbours`` is an array of
    ``struct(dist, rid, v, cnt, lsum)`` sorted by distance, then by ``rid``, covering at least ``k``
    points (``rid`` = least id of that vector, ``cnt`` = its multiplicity, ``lsum`` = sum of its labels).
    With ``exclude_self`` the query's own id is removed (queries and refs share ids).
    ``features`` are numeric columns, or one column that holds the whole vector as an array.
    """
    _refuse_nulls(queries, features)
    _refuse_nulls(refs, features)
    vector = F.col(features[0]) if dict(refs.dtypes)[features[0]].startswith("array") else _vec(features)
    lab = F.col(label).cast("double") if label else F.lit(0.0)
    # Distinct vectors with multiplicity: map-side combined, a hot vector is one row.
    r = refs.select(F.col(rid).alias("rid"), vector.alias("v"), lab.alias("l")).groupBy("v").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("cnt"), F.sum("l").alias("lsum"))
    q = queries.select(F.col(qid).alias("qid"), vector.alias("qv"))
    out, _ = nearest(q, r, k + (1 if exclude_self else 0), target_per_cell)
    if exclude_self:
        # Drop one copy of the query's own vector (distance 0) from its list.
        out = out.withColumn("nbrs", _drop_self(F.col("nbrs")))
    return out.select(F.col("qid").alias(qid), F.col("nbrs").alias("neighbours"))


def _drop_self(nbrs: Column) -> Column:
    first = F.element_at(nbrs, 1)
    reduced = F.when(first["cnt"] > 1, F.concat(
        F.array(F.struct(first["dist"].alias("dist"), first["rid"].alias("rid"), first["v"].alias("v"),
                         (first["cnt"] - 1).alias("cnt"),
                         (first["lsum"] * (first["cnt"] - 1) / first["cnt"]).alias("lsum"))), F.slice(nbrs, 2, 1 << 30))) \
        .otherwise(F.slice(nbrs, 2, 1 << 30))
    return F.when(first["dist"] == 0.0, reduced).otherwise(nbrs)


def _refuse_nulls(df: DataFrame, features: list[str]) -> None:
    """Distances need every coordinate; impute before."""
    seen = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)]).first()
    empty = [c for i, c in enumerate(features) if seen[i]]
    if empty:
        raise ValueError(f"null values in {', '.join(empty)}; impute them first")


def knn_predict(queries: DataFrame, refs: DataFrame, features: list[str], label: str, k: int, qid: str,
                rid: str) -> DataFrame:
    """P(class 1) = mean label of the k nearest training points (multiplicities
    of the last distance group are used partially)."""
    nn = knn(queries, refs, features, k, qid, rid, label=label)

    def take(acc, x):
        use = F.least(x["cnt"], F.greatest(F.lit(k) - acc["c"], F.lit(0)))
        return F.struct((acc["c"] + use).alias("c"), (acc["s"] + use * (x["lsum"] / x["cnt"])).alias("s"))
    agg = F.aggregate("neighbours", F.struct(F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("s")), take)
    return nn.select(qid, (agg["s"] / agg["c"]).alias("p"))


def smote(df: DataFrame, label: str, key: str, features: list[str] | None = None, k: int = 5,
          seed: int = 42) -> DataFrame:
    """Oversample the minority class to parity with interpolated points.

    Each minority row gets ``floor(m / n) (+1 for the first m mod n rows by hash
    rank)`` synthetic rows, ``m`` = majority - minority count; the i-th synthetic
    row of point x is ``x + u * (nn - x)`` with the neighbour (among its ``k``
    nearest minority points, self excluded) and ``u`` drawn from
    ``xxhash64(key, i, seed)``. Returns the input plus the synthetic rows (numeric
    ``features`` interpolated, other columns copied from x).
    """
    from .evaluate import class_rank
    feats = features or [c for c, t in df.dtypes if t in ("double", "int", "bigint", "float") and c not in (label, key)]
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    minority = min(counts, key=counts.get)
    n_min, n_maj = counts[minority], max(counts.values())
    m = n_maj - n_min
    if m == 0:
        return df
    mino = df.where(F.col(label) == minority)
    nn = knn(mino, mino, feats, k, key, key, exclude_self=True)
    base, extra = m // n_min, m % n_min
    ranked = class_rank(mino, label, key, seed)
    reps = F.lit(base) + F.when(F.col("class_rank") <= extra, 1).otherwise(0)
    x = ranked.join(nn, key).where(reps > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), reps)))
    # Neighbour index (0-based over the k nearest points, multiplicities expanded).
    there = F.aggregate("neighbours", F.lit(0).cast("long"), lambda n, y: n + y["cnt"])
    x = x.where(there > 0)   # a class of one row has no neighbour to go towards
    pick = F.pmod(F.xxhash64(F.col(key), F.col("__i"), F.lit(seed)), F.least(F.lit(k).cast("long"), there))
    u = (F.abs(F.xxhash64(F.col(key), F.col("__i"), F.lit(seed + 1))) % 1_000_000) / 1_000_000.0
    chosen = F.aggregate("neighbours", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("array<double>").alias("v")),
                         lambda acc, y: F.struct((acc["c"] + y["cnt"]).alias("c"),
                                                 F.when(acc["v"].isNull() & (pick < acc["c"] + y["cnt"]), y["v"])
                                                 .otherwise(acc["v"]).alias("v")))
    x = x.withColumn("__nn", chosen["v"]).withColumn("__u", u)
    types = dict(df.dtypes)
    if types[feats[0]].startswith("array"):   # the whole vector in one column
        between = F.zip_with(feats[0], "__nn", lambda a, b: a + F.col("__u") * (b - a))
        return df.unionByName(x.select(*[between.alias(c) if c == feats[0] else F.col(c) for c in df.columns]))
    synth = x.select(*[
        (F.col(c).cast("double") + F.col("__u") * (F.col("__nn")[i] - F.col(c).cast("double"))).cast(dict(df.dtypes)[c]).alias(c)
        if c in feats else F.col(c) for i, c in enumerate_feats(df.columns, feats)])
    return df.unionByName(synth)


def enumerate_feats(columns: list[str], feats: list[str]):
    idx = {c: i for i, c in enumerate(feats)}
    return [(idx.get(c, -1), c) for c in columns]
