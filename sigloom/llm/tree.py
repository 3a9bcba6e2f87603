"""A small decision tree (Gini, axis-parallel) for tables of a few hundred labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    share: float  # of label 1
    feature: int = -1
    bar: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def fit(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 1) -> Node:
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or not 0 < node.share < 1:
        return node
    best = (_gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bar in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bar
            if min(low.sum(), (~low).sum()) >= leaf:
                best = min(best, (_gini(y[low]) + _gini(y[~low]), f, float(bar)))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.feature, node.bar = best[1], best[2]
        node.low, node.high = fit(x[low], y[low], depth - 1, leaf), fit(x[~low], y[~low], depth - 1, leaf)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    """Share of label 1 in each row's leaf."""
    if node.feature < 0 or not len(x):
        return np.full(len(x), node.share)
    low = x[:, node.feature] <= node.bar
    out = np.empty(len(x))
    out[low], out[~low] = predict(node.low, x[low]), predict(node.high, x[~low])
    return out
