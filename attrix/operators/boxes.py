"""Exact nearest neighbours in many dimensions: k-d boxes with distance bounds.

A k-d tree of at most ``LEAVES`` leaves is grown on a sample of the distinct reference vectors (any number of dimensions,
one-hot slots included): always at the median of the dimension that varies most. All reference vectors descend it in their
tasks; an aggregate gives every leaf's box and count. No point of a box is nearer to a query than the box itself, and a box
follows its points far closer than a ball does when dimensions are many and partly discrete. Two rounds give the exact answer:

1. each query visits the nearest boxes until they hold a few times k points; its k-th distance there bounds the true one;
2. it visits every other box that is not farther than that, and takes only points within the bound.

A leaf's points are dealt by hash into pieces of about ``PIECE`` rows, and the queries of a leaf into as many tasks as they
need, so a dense leaf or a popular one is no task of its own. Distances within a piece are array operations over Arrow
batches. Tree and boxes are bounded by constants, so they travel with the tasks whatever the data's size.

Equal vectors are one point with a multiplicity. Points are ordered by distance, rounded to 1e-9, then by the least id, so
ties have a defined order. Null vectors are refused by the callers; no reference points give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Leaves of the tree, sampled vectors that it grows on, rows of a piece, queries of a task.
LEAVES, SAMPLE, PIECE, QUERIES = 4096, 1 << 16, 1024, 2048
#: Times the wanted points that the first round visits.
FIRST = 8
#: Cells of a block of distances computed at a time.
CELLS = 1 << 22
#: Room for rounding errors of bounds, relative to the distances.
SLACK = 1e-9


class Tree:
    """Splits of a k-d tree: inner nodes have a dimension, a threshold and two children, leaves a number."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.dim, self.at, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        todo = [(np.arange(len(x)), None)]
        while todo:
            rows, parent = todo.pop()
            node = len(self.dim)
            if parent is not None:
                self.children[parent[0]][parent[1]] = node
            split = self._split(x, rows) if len(rows) > leaf else None
            self.dim.append(-1 if split is None else split[0])
            self.at.append(0.0 if split is None else split[1])
            self.children.append([-1, -1])
            self.leaf.append(self.leaves if split is None else -1)
            if split is None:
                self.leaves += 1
            else:
                right = x[rows, split[0]] > split[1]
                todo += [(rows[right], (node, 1)), (rows[~right], (node, 0))]

    @staticmethod
    def _split(x: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
        """The dimension that varies most and a threshold with rows on both sides: the median, or else the mean."""
        some = x[rows]
        dim = int(some.var(axis=0).argmax())
        for at in (np.median(some[:, dim]), some[:, dim].mean()):
            if (some[:, dim] <= at).any() and (some[:, dim] > at).any():
                return dim, float(at)
        return None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        dim, at, children, leaf = (np.array(v) for v in (self.dim, self.at, self.children, self.leaf))
        node = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(dim[node] >= 0)
            if not len(inner):
                return leaf[node]
            here = node[inner]
            node[inner] = children[here, (x[inner, dim[here]] > at[here]).astype(int)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[row of a, row of b]: by differences, not by products, so that equal vectors are at 0 and ties stay ties."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None]
        out[at : at + step] = np.sqrt(np.einsum("qrd,qrd->qr", d, d))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A column of vectors of one length, as it is and as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def nearest(queries: DataFrame, refs: DataFrame, need: int, per_leaf: int = 32) -> tuple[DataFrame, DataFrame]:
    """The ``need`` nearest points of every query, and how many pairs were compared.

    ``queries`` is (qid, qv); ``refs`` is (v, rid, cnt, lsum) with distinct vectors. Returns (qid, nbrs) with ``nbrs`` an array
    of (dist, rid, v, cnt, lsum) in order that covers at least ``need`` points where there are as many, and (pairs).
    """
    spark = refs.sparkSession
    refs = cut_lineage(refs.select("v", "rid", F.col("cnt").cast("long").alias("cnt"), F.col("lsum").cast("double").alias("lsum")))
    n = refs.count()
    kind = queries.schema["qid"].dataType.simpleString()
    rkind = refs.schema["rid"].dataType.simpleString()
    found = f"qid {kind}, nbrs array<struct<dist: double, rid: {rkind}, v: array<double>, cnt: bigint, lsum: double>>"
    if not n:
        return spark.createDataFrame([], found), spark.createDataFrame([(0,)], "pairs long")
    # At most SAMPLE vectors come to the driver; the tree only shapes the work, the boxes are those of all points.
    sample = _matrix(pd.Series([r["v"] for r in refs.orderBy(F.xxhash64("v"), "rid").limit(SAMPLE).select("v").collect()]))
    tree = Tree(sample, max(1, round(max(per_leaf, n / LEAVES) * len(sample) / n)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.leaf_of(_matrix(batch["v"])).astype("int32"))

    dealt = cut_lineage(refs.mapInPandas(assign, f"v array<double>, rid {rkind}, cnt long, lsum double, leaf int"))
    width = sample.shape[1]
    boxes = dealt.groupBy("leaf").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n"), *[f(F.get("v", F.lit(j))).alias(f"{m}{j}") for m, f in (("lo", F.min), ("hi", F.max)) for j in range(width)])
    boxes = boxes.orderBy("leaf").toPandas()   # a row for each leaf of the tree
    leaf, cnt = boxes["leaf"].to_numpy(), boxes["cnt"].to_numpy()
    lo, hi = (boxes[[f"{m}{j}" for j in range(width)]].to_numpy(float) for m in ("lo", "hi"))
    sizes = spark.createDataFrame([(int(a), int(b)) for a, b in zip(leaf, -(-boxes["n"] // PIECE))], "leaf int, pieces int")
    stored = dealt.join(F.broadcast(sizes), "leaf").withColumn("piece", F.pmod(F.xxhash64("v", F.lit(7)), F.col("pieces")).cast("int")).drop("pieces")

    def visits(later: bool):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 256):
                    some = batch.slice(start, 256)
                    q = _vectors(some.column("qv"))[1]
                    least, middle = np.empty((len(q), len(leaf))), np.empty((len(q), len(leaf)))
                    for i, v in enumerate(q):
                        least[i] = np.sqrt((np.maximum(np.maximum(lo - v, v - hi), 0) ** 2).sum(axis=1))
                        middle[i] = (((lo + hi) / 2 - v) ** 2).sum(axis=1)
                    order = np.lexsort((middle, least), axis=1)
                    before = np.cumsum(cnt[order], axis=1) - cnt[order]
                    chosen = np.zeros(least.shape, bool)
                    np.put_along_axis(chosen, order, before < FIRST * need, axis=1)
                    bound = some.column("bound").to_numpy(zero_copy_only=False).astype(float)
                    bound = np.where(np.isnan(bound), np.inf, bound)
                    if later:
                        chosen = ~chosen & (least * (1 - SLACK) <= bound[:, None] + SLACK)
                    row, col = np.nonzero(chosen)
                    met = pa.array(row)
                    yield pa.RecordBatch.from_arrays([some.column("qid").take(met), some.column("qv").take(met), pa.array(bound[row]), pa.array(leaf[col].astype("int32"))],
                                                     ["qid", "qv", "bound", "leaf"])
        return plan

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        # By whole arrays: what a list holds is taken from the columns, no value becomes an object.
        vectors, points = _vectors(r["v"])
        if not len(q) or not len(r):
            kept, counts, at, near = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:
            d = np.rint(distances(_vectors(q["qv"])[1], points) * 1e9) / 1e9
            rid, many = r["rid"].to_numpy(), r["cnt"].to_numpy()
            rank = np.argsort(np.argsort(rid, kind="stable"), kind="stable")
            # No more than ``need`` points are wanted, so none beyond the distance of that one.
            last = min(need, len(r)) - 1
            limit = np.fmin(q["bound"].to_numpy(), np.partition(d, last, axis=1)[:, last])
            own, at = np.nonzero(d <= limit[:, None])
            order = np.lexsort((rank[at], d[own, at], own))
            own, at = own[order], at[order]
            begin = np.searchsorted(own, own)
            total = np.concatenate([[0], np.cumsum(many[at])])
            some = total[:-1] - total[begin] < need
            own, at = own[some], at[some]
            near = d[own, at]
            counts = np.bincount(own, minlength=len(q))
            kept = np.flatnonzero((counts > 0) | (np.arange(len(q)) == 0))      # the first query carries the number of pairs
            counts = counts[kept]
        take = pa.array(at, pa.int64())
        nbrs = pa.StructArray.from_arrays([pa.array(near, pa.float64()), r["rid"].combine_chunks().take(take), vectors.take(take),
                                           r["cnt"].combine_chunks().take(take), r["lsum"].combine_chunks().take(take)], ["dist", "rid", "v", "cnt", "lsum"])
        pairs = np.where(kept == 0, len(q) * len(r), 0)
        return pa.table([q["qid"].combine_chunks().take(pa.array(kept, pa.int64())), _lists(counts, nbrs), pa.array(pairs, pa.int64())], ["qid", "nbrs", "pairs"])

    def searched(some: DataFrame) -> DataFrame:
        # Every piece of a leaf meets its queries, in groups of about QUERIES.
        some = cut_lineage(some)
        loads = some.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        q = some.join(F.broadcast(sizes), "leaf").join(F.broadcast(loads), "leaf")
        q = q.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("group", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int"))
        r = stored.join(F.broadcast(loads), "leaf").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        keys = ["leaf", "piece", "group"]
        return q.select(*keys, "qid", "qv", "bound").groupBy(*keys).cogroup(r.select(*keys, "v", "rid", "cnt", "lsum").groupBy(*keys)).applyInArrow(compare, found + ", pairs long")

    def merged(df: DataFrame) -> DataFrame:
        # At most the lists of a query's own pieces, each cut to what covers ``need`` points.
        joined = F.array_sort(F.flatten(F.collect_list("nbrs")))
        return df.groupBy("qid").agg(_covering(joined, need).alias("nbrs"), F.sum("pairs").alias("pairs"))

    queries = cut_lineage(queries.select("qid", "qv"))
    plan = f"qid {kind}, qv array<double>, bound double, leaf int"
    one = cut_lineage(merged(searched(queries.withColumn("bound", F.lit(None).cast("double")).mapInArrow(visits(False), plan))))
    bounded = queries.join(one.select("qid", _reach("nbrs", need).alias("bound")), "qid", "left")
    two = searched(bounded.mapInArrow(visits(True), plan))
    both = cut_lineage(merged(one.select("qid", "nbrs", "pairs").unionByName(two)))
    return both.select("qid", "nbrs"), both.select(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def _reach(nbrs: str, need: int):
    """Distance at which the list covers ``need`` points, or null."""
    state = F.aggregate(nbrs, F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("d")), lambda a, x: F.struct(
        (a["c"] + x["cnt"]).alias("c"), F.when(a["d"].isNull() & (a["c"] + x["cnt"] >= need), x["dist"]).otherwise(a["d"]).alias("d")))
    return state["d"]


def _covering(nbrs, need: int):
    """The shortest start of a sorted list that covers ``need`` points."""
    count = F.aggregate(nbrs, F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("n")), lambda a, x: F.struct(
        (a["c"] + x["cnt"]).alias("c"), (a["n"] + (a["c"] < need).cast("int")).alias("n")))
    return F.slice(nbrs, F.lit(1), F.greatest(count["n"], F.lit(1)))
