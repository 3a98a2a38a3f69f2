"""Attribution of fitted pipelines (F3-F7, F10): exact for trees and linear models, summed to raw columns inside the row.

Trees (F4): Shapley values of the path-dependent value of a tree ensemble, without subsets and without sampling. Along the
path to a leaf let feature j have the share ``z_j`` of its rows that follow the path at splits on j, and let ``o_j`` be 1 if
the row itself would follow it, else 0. With v the leaf's value, feature f gets from the leaf

    v * (o_f - z_f) * integral over t in [0, 1] of the product over j != f of (z_j * (1 - t) + o_j * t)

since the integral of ``t**s * (1 - t)**(D - 1 - s)`` is Shapley's weight of subsets of s features. The product is a
polynomial of degree D - 1, so Gauss-Legendre nodes, half as many as the path has features, integrate it exactly. Leaves go
to the tasks as arrays (a model's size, not the data's), and a Pandas UDF evaluates a batch of rows with a few array
operations per tree; the scan is map-only.

Linear models (F3): ``coef_j * (x_j - mean_j)`` with training means of the assembled vector, which one aggregate gives.

Slots of the assembled vector are contiguous per raw column, so one-hot terms sum to their column by slicing (F5); scaling
to points (F6), ranking (F7) and texts are array expressions of the same row: no join, no shuffle. Rows that hold a null
vector get null contributions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from .explain import label_expr
from .score import risk_score

#: Row values times conditions that one step of the kernel holds.
KERNEL_CELLS = 1 << 22


@dataclass
class Leaves:
    """The leaves of one tree: padded arrays [leaf, feature of its path]; padding has share 1 and always holds."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray          # a row follows the path if low < x <= high ...
    high: np.ndarray
    allowed: np.ndarray      # ... and, for a categorical feature, if this row of ``categories`` holds x
    share: np.ndarray
    categories: np.ndarray

    def follows(self, x: np.ndarray) -> np.ndarray:
        """[row, leaf, feature of its path]: whether the row itself would follow the path at the splits on that feature."""
        at = x[:, self.feature]
        out = (at > self.low) & (at <= self.high)
        if self.categories.shape[0] > 1:
            code = np.clip(at, 0, self.categories.shape[1] - 1).astype(int)
            out &= self.categories[np.broadcast_to(self.allowed, at.shape), code]
        return out

    def expected(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())


def tree_leaves(model) -> list[Leaves]:
    """The leaves of every tree of a fitted MLlib tree or ensemble, from its saved node table.

    The value of a leaf is its share of class 1 for classifiers, averaged over the trees of a forest, and twice its weighted
    prediction for boosted trees, so that values add up to the probability or to the log-odds of class 1.
    """
    nodes, weights, boosted = _saved_nodes(model)
    every = []
    for tree, weight in enumerate(weights):
        table = nodes[tree]

        def leaf_value(n) -> float:
            stats = n["impurityStats"]
            return 2 * weight * n["prediction"] if boosted else stats[1] / sum(stats) / len(weights) if len(stats) > 1 else n["prediction"]

        def cover(n) -> float:
            return n["impurityStats"][0] if boosted else sum(n["impurityStats"])

        paths = []
        todo = [(table[0], {})]
        while todo:
            node, path = todo.pop()
            if node["leftChild"] < 0:
                paths.append((leaf_value(node), path))
                continue
            split = node["split"]
            j, values, arity = split["featureIndex"], list(split["leftCategoriesOrThreshold"]), split["numCategories"]
            for child, left in ((table[node["leftChild"]], True), (table[node["rightChild"]], False)):
                low, high, kept, share = path.get(j, (-np.inf, np.inf, None, 1.0))
                if arity < 0:
                    low, high = (low, min(high, values[0])) if left else (max(low, values[0]), high)
                else:
                    side = frozenset(range(arity)) & {int(c) for c in values} if left else frozenset(range(arity)) - {int(c) for c in values}
                    kept = side if kept is None else kept & side
                todo.append((child, path | {j: (low, high, kept, share * cover(child) / cover(node))}))
        every.append(_padded(paths))
    return every


def _saved_nodes(model) -> tuple[dict[int, dict[int, dict]], list[float], bool]:
    """({tree: {node: row}}, tree weights, boosted) as MLlib saves them; as large as the model, which the driver holds anyway."""
    from ..sources.files import scratch_path
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
        weights = [float(w) for w in model.treeWeights]
    else:
        rows = data.withColumn("treeID", F.lit(0)).collect()
        weights = [1.0]
    nodes: dict[int, dict[int, dict]] = {}
    for r in rows:
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    return nodes, weights, "GBT" in type(model).__name__


def _padded(paths: list[tuple[float, dict]]) -> Leaves:
    width = max(max(len(p) for _, p in paths), 1)
    shape = (len(paths), width)
    out = Leaves(np.array([v for v, _ in paths]), np.zeros(shape, int), np.full(shape, -np.inf), np.full(shape, np.inf), np.zeros(shape, int), np.ones(shape), np.ones((1, 1), bool))
    sets: dict[frozenset, int] = {}
    for i, (_, path) in enumerate(paths):
        for k, (j, (low, high, kept, share)) in enumerate(path.items()):
            out.feature[i, k], out.low[i, k], out.high[i, k], out.share[i, k] = j, low, high, share
            if kept is not None:
                out.allowed[i, k] = sets.setdefault(kept, len(sets) + 1)
    if sets:
        out.categories = np.ones((len(sets) + 1, 1 + max((max(s, default=0) for s in sets), default=0) + 1), bool)
        for s, k in sets.items():
            out.categories[k] = np.isin(np.arange(out.categories.shape[1]), list(s))
    return out


def tree_shapley(trees: list[Leaves], x: np.ndarray) -> np.ndarray:
    """[row, feature]: exact Shapley values of the ensemble for the rows of x."""
    out = np.zeros(x.shape)
    for tree in trees:
        leaves, width = tree.share.shape
        nodes, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        nodes, weights = (nodes + 1) / 2, weights / 2
        place = np.zeros((leaves * width, x.shape[1]))
        place[np.arange(leaves * width), tree.feature.ravel()] = 1.0
        step = max(1, KERNEL_CELLS // (leaves * width))
        for a in range(0, len(x), step):
            own = tree.follows(x[a : a + step]).astype(float)
            total = np.zeros(own.shape)
            for t, w in zip(nodes, weights):
                factor = tree.share * (1 - t) + own * t
                total += w * np.divide(factor.prod(axis=2, keepdims=True), factor)
            total *= (own - tree.share) * tree.value[:, None]
            out[a : a + step] += total.reshape(len(total), -1) @ place
    return out


def tree_values(trees: list[Leaves], x: np.ndarray) -> np.ndarray:
    """The ensemble's value for the rows of x, from the same leaves."""
    return sum((t.follows(x).all(axis=2) * t.value).sum(axis=1) for t in trees)


def shapley_column(trees: list[Leaves], features: Column) -> Column:
    """array<double>: a contribution for every slot of the feature vector."""

    @F.pandas_udf("array<double>")
    def contributions(vectors: pd.Series) -> pd.Series:
        some = vectors.dropna()
        found = tree_shapley(trees, np.stack(some.to_list())) if len(some) else []
        return pd.Series(list(found), index=some.index, dtype=object).reindex(vectors.index)

    return contributions(vector_to_array(features))


def slot_columns(model: PipelineModel) -> list[tuple[str, int]]:
    """(raw column, number of slots) in the order of the assembled vector, from the fitted stages.

    Numeric columns have a slot each, a categorical one a slot for each value seen in training and one for all others.
    """
    raw: dict[str, tuple[str, int]] = {}
    groups: dict[str, list[tuple[str, int]]] = {}
    for stage in model.stages:
        if isinstance(stage, ImputerModel):
            raw |= {o: (i, 1) for i, o in zip(stage.getInputCols(), stage.getOutputCols())}
        elif isinstance(stage, StringIndexerModel):
            raw |= {o: (i, 1) for i, o in zip(stage.getInputCols(), stage.getOutputCols())}
        elif isinstance(stage, OneHotEncoderModel):
            extra = (stage.getHandleInvalid() == "keep") - stage.getDropLast()
            raw |= {o: (raw.get(i, (i, 1))[0], n + extra) for i, o, n in zip(stage.getInputCols(), stage.getOutputCols(), stage.categorySizes)}
        elif isinstance(stage, VectorAssembler):
            groups[stage.getOutputCol()] = [g for c in stage.getInputCols() for g in groups.get(c, [raw.get(c, (c, 1))])]
        elif stage.hasParam("inputCol") and stage.isDefined("inputCol") and stage.getInputCol() in groups:    # scaler
            groups[stage.getOutputCol()] = groups[stage.getInputCol()]
    return groups["features"]


def method_of(estimator) -> str:
    """tree or linear attribution by the model's kind; anything else is explained by ablation."""
    name = type(estimator).__name__
    if any(k in name for k in ("RandomForest", "GBT", "DecisionTree")):
        return "tree"
    return "linear" if "LogisticRegression" in name else "ablation"


@dataclass
class Explainer:
    """What a fitted pipeline needs to explain rows: its slots and either leaves or coefficients with training means."""

    model: PipelineModel
    method: str
    slots: list[tuple[str, int]]
    base_value: float
    trees: list[Leaves] | None = None
    coefficients: list[float] | None = None
    means: list[float] | None = None

    @staticmethod
    def fit(model: PipelineModel, train: DataFrame) -> Explainer:
        """From a fitted pipeline; linear models need one aggregate over the training rows for their means."""
        last = model.stages[-1]
        method, slots = method_of(last), slot_columns(model)
        if method == "tree":
            trees = tree_leaves(last)
            return Explainer(model, method, slots, sum(t.expected() for t in trees), trees=trees)
        if method == "linear":
            mean = PipelineModel(model.stages[:-1]).transform(train).select(Summarizer.mean(F.col("features"))).first()[0]
            mean = [float(v) for v in mean.toArray()] if mean is not None else [0.0] * sum(n for _, n in slots)
            coef = [float(v) for v in last.coefficients.toArray()]
            return Explainer(model, method, slots, float(last.intercept) + sum(c * m for c, m in zip(coef, mean)), coefficients=coef, means=mean)
        raise ValueError(f"{type(last).__name__} has no exact attribution; explain it by ablation")

    def _by_slot(self) -> Column:
        if self.trees is not None:
            return shapley_column(self.trees, F.col("features"))
        terms = [F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in zip(self.coefficients, self.means)]
        return F.zip_with(vector_to_array("features"), F.array(*terms), lambda x, t: t["c"] * (x - t["m"]))

    def contributions(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p``, ``risk_score`` and ``contributions``: an array of (feature, value, raw), one for each raw column."""
        keep = df.columns
        out = self.model.transform(df).withColumn("p", vector_to_array("probability")[1])
        out = out.withColumn("risk_score", risk_score("p")).withColumn("__slots", self._by_slot())
        out = out.select(*keep, *[c for c in ("p", "risk_score") if c not in keep], "__slots")
        items, at = [], 1
        for name, n in self.slots:
            total = F.aggregate(F.slice("__slots", at, n), F.lit(0.0), lambda a, v: a + v)
            value = F.col(f"`{name}`").cast("string") if name in keep else F.lit(None).cast("string")
            items.append(F.struct(F.lit(name).alias("feature"), value.alias("value"), total.alias("raw")))
            at += n
        return out.withColumn("contributions", F.array(*items)).drop("__slots")

    def explain(self, df: DataFrame, key: str, top_k: int = 5) -> DataFrame:
        """(key, risk_score, risk_level, method, base_value, factors), all inside the row.

        Contributions are scaled to points (F6); factors are the ``top_k`` largest by size, equal ones by name (F7), as
        (rank, feature, label, value, contribution).
        """
        if top_k < 1:
            raise ValueError("top_k must be >= 1")
        x = self.contributions(df).withColumn("contributions", in_points("contributions", "risk_score"))
        ranked = F.slice(F.array_sort(F.transform("contributions", lambda c: F.struct(
            (-F.abs(c["points"])).alias("size"), c["feature"].alias("feature"), c["value"].alias("value"), c["points"].alias("points")))), 1, top_k)
        factors = F.transform(ranked, lambda c, i: F.struct((i + 1).alias("rank"), c["feature"].alias("feature"), label_expr(c["feature"]).alias("label"),
                                                            c["value"].alias("value"), c["points"].alias("contribution")))
        return x.select(key, "risk_score", risk_level("risk_score").alias("risk_level"), F.lit(f"shap_{self.method}").alias("method"),
                        F.lit(self.base_value).alias("base_value"), factors.alias("factors"))


def in_points(contributions: str, score: str) -> Column:
    """F6 in the row: ``raw * (score - 50) / sum|raw|``; ``raw / sum|raw|`` at a score of 50; zeros when the sum is at most 1e-12."""
    total = F.aggregate(contributions, F.lit(0.0), lambda a, c: a + F.abs(c["raw"]))
    gap = F.col(score) - 50.0
    factor = F.when(F.abs(gap) > 1e-6, gap / total).otherwise(1.0 / total)
    points = lambda c: F.when(total <= 1e-12, F.lit(0.0)).otherwise(F.rint(c["raw"] * factor * 100) / 100)
    return F.transform(contributions, lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value"), c["raw"].alias("raw"), points(c).alias("points")))
