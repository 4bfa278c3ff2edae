"""Gradient-boosted regression trees on small numeric feature matrices (logistic loss, binned features)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees fitted to the gradients of the logistic loss with shrinkage."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.model, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if len(y) else 1e-3
        self.base, self.model = float(np.log(share / (1 - share))), []
        if len(y) == 0:
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, weight * (p - y), weight * p * (1 - p), np.arange(len(y)), self.depth)
            self.model.append(tree)
            raw += self.rate * self._walk(tree, binned, len(y))
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -gs / (hs + self.ridge)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best, found = 1e-6, None
        for f in range(b.shape[1]):
            k = len(self.cuts[f]) + 1
            gl, hl, n = (np.cumsum(np.bincount(b[rows, f], w, k)) for w in (g[rows], h[rows], None))
            ok = (n >= self.least) & (len(rows) - n >= self.least)
            gain = np.where(ok, gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge), 0)
            if gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        if found is None:
            return leaf
        f, cut = found
        left = b[rows, f] <= cut
        return f, cut, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _walk(self, tree, b: np.ndarray, n: int) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(n, tree)
        f, cut, low, high = tree
        return np.where(b[:, f] <= cut, self._walk(low, b, n), self._walk(high, b, n))

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if self.model and len(x):
            binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
            for tree in self.model:
                raw += self.rate * self._walk(tree, binned, len(x))
        return 1 / (1 + np.exp(-raw))
