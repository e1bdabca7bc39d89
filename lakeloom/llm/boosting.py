"""Gradient-boosted trees for a few thousand rows of statistics (softmax, histogram splits), in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in breadth order; node n has the children 2n+1 and 2n+2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            go = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(go, 2 * at + 1 + right, at)
        return self.value[at]


@dataclass
class Boosted:
    """``scores`` are softmax inputs, ``temperature`` calibrates them."""

    classes: list[str]
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    rate: float = 0.3
    temperature: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.tile(self.base, (len(x), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                s[:, k] += self.rate * t.apply(x)
        return s

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature)

    def calibrate(self, x: np.ndarray, labels: list[str]) -> float:
        """Sets the temperature with the least log loss on held-out rows; returns that loss."""
        s, y = self.scores(x), np.array([self.classes.index(c) for c in labels])
        loss = lambda t: -np.log(np.maximum(_softmax(s / t)[np.arange(len(y)), y], 1e-12)).mean()
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(min(grid, key=loss))
        return float(loss(self.temperature))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    rows = {0: np.arange(len(g))}
    bins = max(map(len, cuts)) + 1
    n_features = codes.shape[1]
    for node in range(size):
        r = rows.pop(node, None)
        if r is None:
            continue
        gs, hs = g[r].sum(), h[r].sum()
        value[node] = -gs / (hs + l2)
        if node >= size // 2 or len(r) < 2 * least:
            continue
        flat = (codes[r] + np.arange(n_features) * bins).ravel()
        shape = (n_features, bins)
        gb = np.bincount(flat, np.repeat(g[r], n_features), n_features * bins).reshape(shape).cumsum(axis=1)
        hb = np.bincount(flat, np.repeat(h[r], n_features), n_features * bins).reshape(shape).cumsum(axis=1)
        nb = np.bincount(flat, minlength=n_features * bins).reshape(shape).cumsum(axis=1)
        gain = gb**2 / (hb + l2) + (gs - gb) ** 2 / (hs - hb + l2) - gs**2 / (hs + l2)
        gain[(nb < least) | (len(r) - nb < least)] = 0
        f, b = np.unravel_index(gain.argmax(), shape)
        if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
            continue
        feature[node], cut[node] = f, cuts[f][b]
        left = codes[r, f] <= b
        rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
    return Tree(feature, cut, value)


def train(x: np.ndarray, labels: list[str], classes: list[str], rounds: int = 25, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """A model of ``labels``; rows are weighted so that every class that occurs counts the same."""
    y = np.array([classes.index(c) for c in labels], dtype=np.int64)
    counts = np.bincount(y, minlength=len(classes))
    weight = (len(y) / np.maximum(counts, 1) / max(1, (counts > 0).sum()))[y] if len(y) else np.zeros(0)
    present = counts > 0
    model = Boosted(classes, np.where(present, 0.0, -10.0), rate=rate)
    if len(y) == 0 or present.sum() < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    s = np.tile(model.base, (len(y), 1))
    target = np.eye(len(classes))[y]
    for _ in range(rounds):
        p = _softmax(s)
        trees = []
        for k in range(len(classes)):
            t = _grow(codes, cuts, weight * (p[:, k] - target[:, k]), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6), depth, 3, l2)
            trees.append(t)
            s[:, k] += rate * t.apply(x)
        model.rounds.append(trees)
    return model
