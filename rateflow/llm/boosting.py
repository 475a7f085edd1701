"""Gradient-boosted trees for two classes in numpy (histograms of binned features)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    edges: list[np.ndarray]
    base: float
    #: For each tree: split feature, split bin and leaf value by node of a complete binary tree.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = b[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss; splits by gain over feature histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    rate_y = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(edges, float(np.log(rate_y / (1 - rate_y))))
    b = forest.binned(x).astype(np.int64)
    g_out = np.full(len(y), forest.base)
    m, size = x.shape[1], 2 ** (depth + 1) - 1
    flat = b + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-g_out))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(size):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = grad[mine], hess[mine]
            value[node] = -rate * gs.sum() / (hs.sum() + l2)
            if node >= 2**depth - 1 or hs.sum() < 2 * least:
                continue
            where = flat[mine].ravel()
            gh = np.bincount(where, np.repeat(gs, m), m * bins).reshape(m, bins).cumsum(1)
            hh = np.bincount(where, np.repeat(hs, m), m * bins).reshape(m, bins).cumsum(1)
            gl, hl = gh[:, :-1], hh[:, :-1]
            gr, hr = gh[:, -1:] - gl, hh[:, -1:] - hl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs.sum() ** 2 / (hs.sum() + l2)
            gain[(hl < least) | (hr < least)] = -1
            j, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, c] <= 1e-6:
                continue
            feature[node], cut[node] = j, c
            at[mine] = 2 * node + 1 + (b[mine, j] > c)
        g_out += value[at]
        forest.trees.append((feature, cut, value))
    return forest
