"""A small decision tree: Gini splits on numeric features."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6) -> None:
        self.root = self._grow(np.asarray(x, dtype=float), np.asarray(y, dtype=int), depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | int:
        major = int(2 * y.sum() >= len(y))
        if depth == 0 or len(set(y.tolist())) < 2:
            return major
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                impurity = sum(p.sum() * (len(p) - p.sum()) / len(p) for p in (y[left], y[~left]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), left)
        if best is None:
            return major
        _, f, cut, left = best
        return f, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, row: tuple) -> int:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node
