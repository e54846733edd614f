"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

import numpy as np


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)


class Boosted:
    def __init__(self, trees=40, depth=3, rate=0.2, bins=32, least=20):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray, edges: list[np.ndarray]) -> Boosted:
        """Trees of binned rows, each of which stands for ``n`` equal ones; ``edges`` are the borders of bins by feature."""
        self.edges = edges
        rate = min(max(float(np.average(y, weights=n)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, n, n * (y - p), n * p * (1 - p))
            self.forest.append(tree)
            margin += self._leaf(tree, codes)
        return self

    def quantiles(self) -> list[float]:
        """The shares of rows below the borders of bins."""
        return np.linspace(0, 1, self.bins + 1)[1:-1].tolist()

    def codes(self, x):
        return binned(x, self.edges)

    def _grow(self, codes, rows, g, h):
        """A full binary tree: node k has children 2k+1 and 2k+2; feature -1 sends all to the left."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        at = np.zeros(len(g), np.int64)
        for k in range(2**self.depth - 1):
            own = np.flatnonzero(at == k)
            best = (1e-6, -1, 0)
            if rows[own].sum() >= 2 * self.least:
                total, total_g, total_h = rows[own].sum(), g[own].sum(), h[own].sum()
                for j in range(codes.shape[1]):
                    c = codes[own, j]
                    size = int(c.max()) + 1
                    n, sg, sh = (np.cumsum(np.bincount(c, w, size)) for w in (rows[own], g[own], h[own]))
                    ok = (n >= self.least) & (n <= total - self.least)
                    gain = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), -1)
                    if gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            feature[k], cut[k] = best[1:]
            right = codes[own, best[1]] > best[2] if best[1] >= 0 else np.zeros(len(own), bool)
            at[own] = 2 * k + 1 + right
        sums, curve = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[:] = self.rate * sums / (curve + 1)
        return feature, cut, value

    def _leaf(self, tree, codes):
        feature, cut, value = tree
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        for _ in range(self.depth):
            f = feature[at]
            right = (f >= 0) & (codes[rows, np.maximum(f, 0)] > cut[at])
            at = 2 * at + 1 + right
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_of(self.codes(x))

    def probability_of(self, codes: np.ndarray) -> np.ndarray:
        margin = np.full(len(codes), self.base)
        for tree in self.forest:
            margin += self._leaf(tree, codes)
        return 1 / (1 + np.exp(-margin))
