"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label (and one length) are dealt into tiles; every pair of tiles is one group for one task. In a task both
tiles are scaled to length 1 and rounded to int8 codes with a step per vector, and the codes are multiplied as matrices
(exact in single precision up to 1,040 dimensions, in double beyond). With e the length of a vector's rounding error,

    |cos(x, y) - step_x * step_y * <code_x, code_y>|  <=  e_y + e_x * (1 + e_y),

so a pair whose product stays below the threshold by more than that cannot link. All others are recomputed from the
original vectors in double precision. Only counts and a spanning star per local component leave a task, never pairs,
so a large group of near copies costs no quadratic output; components are joined over all tiles afterwards.

Equal vectors are one node with a count, so copies cost nothing more. A frequent label has many tiles, its pairs of
tiles are spread over the cluster, and the bytes sent per vector grow with the tiles of its label: comparing all rows
of a label is quadratic work by definition, but each task is bounded.

Edge cases: vectors that are null, empty, all zero or hold a null, NaN or infinity link with nothing and have themselves
as component; so do rows with a null label; rows with a null id link with nothing, their component is null; rows equal in
id, label and vector count once but each gets a result row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import stored
from attrix.llm.components import connected_components

THRESHOLD = 0.98
TILE = 2048
#: Pairs recomputed in double precision at a time.
EXACT_ROWS = 1 << 16


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector as the bytes of its doubles; null if it cannot link.

    It is scaled by a power of two, which keeps every cosine, so that no square of it over- or underflows.
    """
    for batch in batches:
        out = []
        for v in batch.column("vector").to_pylist():
            x = np.array([np.nan if a is None else a for a in v or ()], np.float64)
            links = len(x) and np.isfinite(x).all() and x.any()
            out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes() if links else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows scaled to length 1, their steps, and the lengths of the rounding errors (rounded up)."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * step[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, step, error


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with a cosine of at least the threshold; i < j if both tiles are one."""
    (cx, sx, ex), (cy, sy, ey) = quantised(x), quantised(y)
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    right, a, b = cy.astype(exact).T, [], []
    for at in range(0, len(x), 256):
        rows = slice(at, at + 256)
        product = (cx[rows].astype(exact) @ right).astype(np.float64) * (sx[rows, None] * sy[None, :])
        bound = ey[None, :] + ex[rows, None] * (1 + ey[None, :])
        i, j = np.nonzero(product + bound >= threshold - 1e-9)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), EXACT_ROWS):
            p, q = i[k : k + EXACT_ROWS], j[k : k + EXACT_ROWS]
            hit = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold
            a.append(p[hit])
            b.append(q[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _tiles(threshold: float):
    def tiles(table: pa.Table) -> pa.Table:
        tile, first, second = (table[c].to_numpy() for c in ("tile", "i", "j"))
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(table), -1)
        same = first[0] == second[0]
        mine = np.flatnonzero(tile == first[0])
        other = mine if same else np.flatnonzero(tile == second[0])
        a, b = linked_pairs(vectors[mine], vectors[other], threshold, same)
        a, b = mine[a], other[b]
        links = np.zeros(len(table), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = node.copy()
        while len(a):
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        there = links > 0
        return pa.table({"node": node[there], "links": links[there], "root": root[there]})
    return tiles


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    rows = stored(rows.mapInArrow(_bytes, "vec_id long, label string, vector binary"), "vectors")
    usable = rows.where("vec_id is not null and label is not null and vector is not null").distinct()
    group = ["label", F.octet_length("vector").alias("size")]
    nodes = stored(usable.groupBy(*group, "vector").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies")), "nodes")
    counts = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = nodes.join(counts, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    paired = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .select("label", "size", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "copies", "vector"))
    found = stored(paired.groupBy("label", "size", "i", "j").applyInArrow(_tiles(threshold), "node long, links long, root long"), "links")
    parts = connected_components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.join(links, "node", "left").join(parts, "node", "left")
             .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    return (rows.join(known, ["label", "vector"], "left")
            .select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
                    F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
