"""Tree ensembles that MLlib lacks (D8, D10, D11, D12), as pipeline stages: histogram boosting, ordered target statistics, extra trees.

All work on the assembled ``features`` vector of a pipeline and add ``probability``, as MLlib's classifiers do, so training,
selection and scoring treat them alike. The driver holds the trees; rows stay where they are:

* **Leaf-wise boosting.** Values are binned once by quantiles and written as bytes. A level of a tree is one pass: each task
  lets its rows descend the present tree and adds gradients and curvatures to histograms by arrays; Spark sums the
  histograms' cells. Only the smaller child of each split is counted, the other one is its parent less that. Growth is best
  first: the gain of a split does not depend on other splits, so a level-wise tree up to ``depth`` holds all candidates,
  and taking splits by falling gain until there are ``leaves`` leaves gives the best-first tree.
* **Ordered target statistics.** A category is replaced by the mean target of the rows before it in hash order (smoothed by
  the overall mean), so no row sees its own target. Running sums are those of hash buckets plus those inside a bucket, so
  a category that holds a third of all rows is many tasks. New rows get the means of all training rows.
* **Extra trees.** Every node tries a few features, each with one cut drawn between the ends its path leaves to the feature.
  All nodes of a level of all trees are scored in one aggregation.
* **AdaBoost** and **k nearest neighbours** are the library's own, wrapped as stages.

Draws depend on the seed and the node alone. Rows without a label are left out; a missing class gives constant scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bins of a feature; buckets of the running sums; smoothing of target statistics.
BINS, BUCKETS, SMOOTHING = 64, 1024, 10.0
#: Rounds of boosting between checkpoints of the rows' margins.
CHECKPOINT = 10


class Tree:
    """Arrays of nodes: a node with ``feature`` -1 is a leaf; others send values at most ``cut`` to ``left``."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0.0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for column, start in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [start, start]
        return a, a + 1

    def node_of(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(x), int)
        while len(inner := np.flatnonzero(feature[node] >= 0)):
            here = node[inner]
            node[inner] = np.where(x[inner, feature[here]] <= cut[here], left[here], right[here])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(x)]


def _doubles(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cells(found: np.ndarray) -> pa.RecordBatch:
    """The rows of a task's sums that are not all zero: cell number and its sums."""
    flat = found.reshape(-1, found.shape[-1])
    at = np.flatnonzero(flat.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(flat[at, k], pa.float64()) for k in range(flat.shape[1]))],
                                      ["cell", *(f"s{k}" for k in range(flat.shape[1]))])


def _summed(rows: DataFrame, task, shape: tuple[int, ...]) -> np.ndarray:
    """Sums of the tasks' arrays of this shape, by cells; as many numbers reach the driver as the trees' level needs."""
    n = shape[-1]
    cells = rows.mapInArrow(task, "cell long, " + ", ".join(f"s{k} double" for k in range(n))).groupBy("cell").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
    got = cells.toPandas()
    out = np.zeros((int(np.prod(shape[:-1])), n))
    out[got["cell"].to_numpy(int)] = got[[f"s{k}" for k in range(n)]].to_numpy(float)
    return out.reshape(shape)


class ScoredModel(Model):
    """A fitted ensemble: adds ``probability`` from an array function of the feature vector."""

    def __init__(self, inputs, score):
        super().__init__()
        self.inputs, self.score = inputs, score     # DataFrame -> array column; matrix -> share of class 1

    def _transform(self, df: DataFrame) -> DataFrame:
        score = self.score

        @F.pandas_udf("double")
        def p(vectors: pd.Series) -> pd.Series:
            return pd.Series(score(np.stack(vectors.to_list())) if len(vectors) else [], index=vectors.index, dtype=float)

        x = self.inputs(df).withColumn("__p", p("__x"))
        return x.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p", "__x")


def _vector(df: DataFrame) -> DataFrame:
    return df.withColumn("__x", vector_to_array("features"))


class _Stage(Estimator):
    def __init__(self, **settings):
        super().__init__()
        self.settings = self.defaults | settings

    def copy(self, extra=None):
        return type(self)(**self.settings)

    def __getattr__(self, name):
        if not name.startswith("_") and "settings" in self.__dict__ and name in self.settings:
            return self.settings[name]
        raise AttributeError(name)


def bin_edges(df: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper ends of all bins but the last, by quantiles; one aggregate."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.get("__x", F.lit(j)), F.array(*map(F.lit, probs)), 10_000).alias(f"e{j}") for j in range(width)],
                 *[F.max(F.get("__x", F.lit(j))).alias(f"m{j}") for j in range(width)]).first()
    return [np.array(sorted({float(v) for v in row[f"e{j}"] or [] if v < row[f"m{j}"]})) for j in range(width)]


def best_first(tree: Tree, gains: dict[int, float], values: dict[int, float], leaves: int) -> Tree:
    """The tree that taking splits by falling gain, each after its parent, makes; ``values`` are those of all nodes."""
    out, open_ = Tree(), [(gains.get(0, 0.0), 0, 0)]
    out.value[0] = values[0]
    have = 1
    while have < leaves:
        gain, old, new = max(open_, key=lambda o: (o[0], -o[1]))
        if gain <= 0:
            break
        open_.remove((gain, old, new))
        for a, b in zip((tree.left[old], tree.right[old]), out.split(new, tree.feature[old], tree.cut[old])):
            out.value[b] = values[a]
            open_.append((gains.get(a, 0.0), a, b))
        have += 1
    return out


class LeafwiseBoosting(_Stage):
    """Boosted trees on histograms, grown best first by Newton gains of the logistic loss.

    ``categorical`` names columns that enter by ordered target statistics beside the vector.
    """

    defaults = {"rounds": 100, "rate": 0.1, "leaves": 31, "depth": 6, "shrink": 1.0, "least": 1e-3, "categorical": (), "seed": 42}

    def _fit(self, df: DataFrame) -> ScoredModel:
        df = df.where(F.col("label").isNotNull())
        stats, frame = (None, _vector(df)) if not self.categorical else ordered_statistics(df, list(self.categorical))
        first = frame.select(F.size("__x").alias("n")).first()
        share = df.agg(F.avg("label").alias("p")).first()["p"]
        inputs = _vector if stats is None else stats
        if first is None or share in (0.0, 1.0, None):
            return ScoredModel(inputs, lambda x, p=share or 0.0: np.full(len(x), p))
        width = first["n"]
        edges = bin_edges(frame, width)
        start = math.log(share / (1 - share))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _doubles(b, "__x", width)
                codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), b.column("label"), pa.array(np.full(len(x), start))], ["x", "label", "margin"])

        rows = cut_lineage(frame.select("__x", F.col("label").cast("double").alias("label")).mapInArrow(binned, "x binary, label double, margin double"))
        trees: list[Tree] = []
        pending: list[Tree] = []
        for turn in range(self.rounds):
            tree = self._grow(rows, width, pending)
            trees.append(tree)
            pending.append(tree)
            if len(pending) == CHECKPOINT and turn + 1 < self.rounds:
                rows, pending = cut_lineage(self._moved(rows, width, pending)), []
        real = [self._on_values(t, edges) for t in trees]
        return ScoredModel(inputs, lambda x: 1 / (1 + np.exp(-(start + sum(t.predict(x) for t in real)))))

    @staticmethod
    def _on_values(tree: Tree, edges: list[np.ndarray]) -> Tree:
        out = Tree()
        out.feature, out.left, out.right, out.value = tree.feature, tree.left, tree.right, tree.value
        out.cut = [float(edges[f][int(c)]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        return out

    @staticmethod
    def _codes(batch: pa.RecordBatch, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, width)

    def _moved(self, rows: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = self._codes(b, width)
                margin = b.column("margin").to_numpy() + sum(t.predict(x) for t in trees)
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("label"), pa.array(margin)], ["x", "label", "margin"])
        return rows.mapInArrow(move, rows.schema)

    def _grow(self, rows: DataFrame, width: int, pending: list[Tree]) -> Tree:
        tree, codes = Tree(), self._codes
        histograms: dict[int, np.ndarray] = {}
        gains: dict[int, float] = {}
        values: dict[int, float] = {}
        counted = [0]
        for level in range(self.depth + 1):
            def task(batches: Iterator[pa.RecordBatch], counted=counted) -> Iterator[pa.RecordBatch]:
                found = np.zeros((len(counted), width, BINS, 2))
                slot = np.full(len(tree.feature), -1)
                slot[counted] = range(len(counted))
                for b in batches:
                    x = codes(b, width)
                    margin = b.column("margin").to_numpy() + sum((t.predict(x) for t in pending), np.zeros(len(x)))
                    p = 1 / (1 + np.exp(-margin))
                    at = slot[tree.node_of(x)]
                    on = at >= 0
                    at, x, g, h = at[on], x[on], (p - b.column("label").to_numpy())[on], (p * (1 - p))[on]
                    for j in range(width):
                        cell = at * BINS + x[:, j]
                        for k, weight in ((0, g), (1, h)):
                            found[:, j, :, k] += np.bincount(cell, weight, len(counted) * BINS).reshape(-1, BINS)
                yield _cells(found)

            sums = _summed(rows, task, (len(counted), width, BINS, 2))
            for node, own in zip(counted, sums):
                histograms[node] = own
            if level:
                for parent in frontier:  # noqa: F821  of the level before
                    a, b = tree.left[parent], tree.right[parent]
                    have, other = (a, b) if a in histograms else (b, a)
                    histograms[other] = histograms.pop(parent) - histograms[have]
            frontier, counted = [], []
            for node in sorted(histograms):
                if node in values:
                    continue
                total = histograms[node][0].sum(axis=0)
                values[node] = -self.rate * total[0] / (total[1] + self.shrink)
                before = np.cumsum(histograms[node], axis=1)[:, :-1]
                after = total - before
                score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.shrink)
                gain = np.where((before[..., 1] >= self.least) & (after[..., 1] >= self.least), score(before) + score(after) - score(total), -np.inf)
                j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if level < self.depth and gain[j, cut] > 1e-9:
                    gains[node] = float(gain[j, cut])
                    a, b = tree.split(node, int(j), float(cut))
                    frontier.append(node)
                    counted.append(a if before[j, cut, 1] <= after[j, cut, 1] else b)
            if not frontier:
                break
        return best_first(tree, gains, values, self.leaves)


def ordered_statistics(df: DataFrame, columns: list[str]):
    """(inputs for new rows, training rows): ``__x`` is the vector with a target statistic per column appended.

    Training rows see the rows before them in the order of a hash of the row; new rows see all training rows. The tables of
    categories are joined, and broadcast by the engine only if they measure small.
    """
    mean = df.agg(F.avg("label")).first()[0] or 0.0
    smooth = lambda total, n: (total + SMOOTHING * mean) / (n + SMOOTHING)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = cut_lineage(_vector(df).select(*[text(c).alias(f"__c{i}") for i, c in enumerate(columns)], F.xxhash64("__x", *columns).alias("__h"),
                                          F.monotonically_increasing_id().alias("__id"), "__x", "label"))
    rows = rows.withColumn("__b", F.pmod("__h", F.lit(BUCKETS)).cast("int"))
    for i in range(len(columns)):
        c, s = f"__c{i}", f"__s{i}"
        parts = rows.groupBy(c, "__b").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
        over = Window.partitionBy(c).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(c, "__b", F.coalesce(F.sum("t").over(over), F.lit(0.0)).alias("__t"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("__n"))
        inside = Window.partitionBy(c, "__b").orderBy("__h", "__id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(parts, [c, "__b"]).withColumn(s, smooth(F.col("__t") + F.coalesce(F.sum("label").over(inside), F.lit(0.0)),
                                                                  F.col("__n") + F.count("label").over(inside))).drop("__t", "__n")
    train = rows.select(F.concat("__x", F.array(*[f"__s{i}" for i in range(len(columns))])).alias("__x"), "label")
    tables = [cut_lineage(df.groupBy(text(c).alias(f"__k{i}")).agg(smooth(F.sum("label"), F.count("label")).alias(f"__s{i}"))) for i, c in enumerate(columns)]

    def inputs(new: DataFrame) -> DataFrame:
        out = _vector(new)
        for i, (c, table) in enumerate(zip(columns, tables)):
            out = out.withColumn(f"__k{i}", text(c)).join(table, f"__k{i}", "left").drop(f"__k{i}")
        return out.withColumn("__x", F.concat("__x", F.array(*[F.coalesce(f"__s{i}", F.lit(mean)) for i in range(len(columns))]))).drop(*[f"__s{i}" for i in range(len(columns))])

    return inputs, train


class ExtraTrees(_Stage):
    """Trees on all rows whose nodes take the best of a few random cuts by the Gini index."""

    defaults = {"trees": 300, "depth": 12, "least": 2, "seed": 42}

    def _fit(self, df: DataFrame) -> ScoredModel:
        frame = _vector(df.where(F.col("label").isNotNull()))
        first = frame.select(F.size("__x").alias("n")).first()
        if first is None:
            return ScoredModel(_vector, lambda x: np.zeros(len(x)))
        width = first["n"]
        ends = frame.agg(*[f(F.get("__x", F.lit(j))).alias(f"{m}{j}") for m, f in (("lo", F.min), ("hi", F.max)) for j in range(width)],
                         F.count("*").alias("n"), F.sum("label").alias("y")).first()
        box = (np.array([ends[f"lo{j}"] for j in range(width)], float), np.array([ends[f"hi{j}"] for j in range(width)], float))
        rows = cut_lineage(frame.select("__x", F.col("label").cast("double").alias("label")))
        tries = max(1, round(math.sqrt(width)))
        forest = [Tree() for _ in range(self.trees)]
        share = float(ends["y"]) / ends["n"]
        # (tree, node): box and (rows, rows of class 1).
        frontier = {(t, 0): (box, (float(ends["n"]), float(ends["y"]))) for t in range(self.trees)}
        for t in forest:
            t.value[0] = share
        for _ in range(self.depth):
            frontier = {k: v for k, v in frontier.items() if v[1][0] >= self.least and 0 < v[1][1] < v[1][0]}
            if not frontier:
                break
            frontier = self._level(rows, width, forest, frontier, tries)
        return ScoredModel(_vector, lambda x: sum(t.predict(x) for t in forest) / len(forest))

    def _level(self, rows: DataFrame, width: int, forest: list[Tree], frontier: dict, tries: int) -> dict:
        keys = list(frontier)
        features, cuts = np.zeros((len(keys), tries), int), np.zeros((len(keys), tries))
        for i, (t, node) in enumerate(keys):
            rng = np.random.default_rng((self.seed, t, node))
            low, high = frontier[t, node][0]
            open_ = np.flatnonzero(high > low)
            if len(open_):
                features[i] = rng.choice(open_, tries, replace=len(open_) < tries)
                cuts[i] = rng.uniform(low[features[i]], high[features[i]])
        slot_of = {t: np.full(len(tree.feature), -1) for t, tree in enumerate(forest)}
        for i, (t, node) in enumerate(keys):
            slot_of[t][node] = i
        grown = sorted({t for t, _ in keys})

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(keys), tries, 2))   # rows at or below the cut, and those of class 1
            for b in batches:
                x, y = _doubles(b, "__x", width), b.column("label").to_numpy()
                for t in grown:
                    at = slot_of[t][forest[t].node_of(x)]
                    on = np.flatnonzero(at >= 0)
                    slots = at[on]
                    for k in range(tries):
                        left = x[on, features[slots, k]] <= cuts[slots, k]
                        found[:, k, 0] += np.bincount(slots[left], minlength=len(keys))
                        found[:, k, 1] += np.bincount(slots[left], y[on][left], len(keys))
            yield _cells(found)

        sums = _summed(rows, task, (len(keys), tries, 2))
        later = {}
        for i, (t, node) in enumerate(keys):
            (low, high), (n, y) = frontier[t, node]
            left = sums[i]
            right = np.array([n, y]) - left
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = sum(np.where(s[:, 0] > 0, 2 * s[:, 1] * (1 - s[:, 1] / np.maximum(s[:, 0], 1)), 0) for s in (left, right))
            impurity = np.where((left[:, 0] > 0) & (right[:, 0] > 0), impurity, np.inf)
            k = int(impurity.argmin())
            if not np.isfinite(impurity[k]):
                continue   # every cut left one side empty
            j, cut = int(features[i, k]), float(cuts[i, k])
            for child, side, end in zip(forest[t].split(node, j, cut), (left[k], right[k]), (1, 0)):
                forest[t].value[child] = float(side[1] / side[0])
                bounds = (low.copy(), high.copy())
                bounds[end][j] = cut
                later[t, child] = (bounds, (float(side[0]), float(side[1])))
        return later


class AdaBoostStumps(_Stage):
    """The library's SAMME AdaBoost over every slot of the vector."""

    defaults = {"rounds": 200, "seed": 42}

    def _fit(self, df: DataFrame) -> Model:
        from .train import adaboost
        width = _vector(df).select(F.size("__x").alias("n")).first()["n"]
        fitted = adaboost(self._slots(df, width), [f"x{j}" for j in range(width)], "label", self.rounds)
        return _ColumnModel(lambda new: self._scored(new, width, fitted))

    @staticmethod
    def _slots(df: DataFrame, width: int) -> DataFrame:
        return _vector(df).select("label", *[F.get("__x", F.lit(j)).alias(f"x{j}") for j in range(width)])

    @staticmethod
    def _scored(df: DataFrame, width: int, fitted) -> DataFrame:
        from .train import adaboost_scores
        keep = df.columns
        x = _vector(df).withColumns({f"x{j}": F.get("__x", F.lit(j)) for j in range(width)})
        return adaboost_scores(x, fitted).select(*keep, "p")


class NearestNeighbours(_Stage):
    """Share of class 1 among the k nearest training rows, exact."""

    defaults = {"k": 15, "seed": 42}

    def _fit(self, df: DataFrame) -> Model:
        refs = cut_lineage(_vector(df).select(F.monotonically_increasing_id().alias("__rid"), "__x", "label"))
        return _ColumnModel(lambda new: self._scored(new, refs))

    def _scored(self, df: DataFrame, refs: DataFrame) -> DataFrame:
        from .neighbors import knn_predict
        rows = cut_lineage(_vector(df).withColumn("__rid", F.monotonically_increasing_id()))
        p = knn_predict(rows.select("__rid", "__x"), refs, ["__x"], "label", self.k, "__rid", "__rid")
        return rows.drop("__x").join(p, "__rid").drop("__rid")


class _ColumnModel(Model):
    def __init__(self, scored):
        super().__init__()
        self.scored = scored

    def _transform(self, df: DataFrame) -> DataFrame:
        p: Column = F.col("p")
        return self.scored(df).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("p")
