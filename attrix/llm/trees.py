"""Trees of a fitted Spark ML ensemble as plain data: conditions of paths, and evaluation on arrays."""

from __future__ import annotations

import re

import numpy as np

#: A condition: (feature index, True for "at most" or False for "above", threshold).
Condition = tuple[int, bool, float]
_LINE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$|^( *)Predict: (\S+)$")


def tree_paths(model) -> list[list[tuple[tuple[Condition, ...], float]]]:
    """Per tree its leaves: the conditions on the way and the prediction."""
    trees = []
    for tree in model.trees:
        path: list[tuple[int, Condition]] = []
        leaves = []
        for line in tree.toDebugString.splitlines()[1:]:
            m = _LINE.match(line)
            if not m:
                continue
            depth = len(m[1] if m[1] is not None else m[5])
            while path and path[-1][0] >= depth:
                path.pop()
            if m[6] is not None:
                leaves.append((tuple(c for _, c in path), float(m[6])))
            else:
                path.append((depth, (int(m[2]), m[3] == "<=", float(m[4]))))
        trees.append(leaves)
    return trees


def evaluate(trees: list[list[tuple[tuple[Condition, ...], float]]], weights: list[float], x: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees' predictions for the rows of x."""
    total = np.zeros(len(x))
    for leaves, w in zip(trees, weights):
        for path, value in leaves:
            here = np.ones(len(x), bool)
            for feature, at_most, threshold in path:
                here &= (x[:, feature] <= threshold) == at_most
            total[here] += w * value
    return total
