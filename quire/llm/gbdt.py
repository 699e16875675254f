"""Gradient-boosted regression trees for a binary label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Each tree is a complete one: feature and threshold of every inner node, value of every leaf."""

    base: float = 0.0
    depth: int = 4
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # bin b: value <= edges[b]
    prior = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(prior / (1 - prior))), depth)
    logit = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * bins + binned[j]
                gs = np.bincount(cell, g, n * bins).reshape(n, bins).cumsum(1)
                hs = np.bincount(cell, h, n * bins).reshape(n, bins).cumsum(1)
                gain = gs**2 / (hs + ridge) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                gain = gain[:, : len(e)]
                top = gain.argmax(1)
                better = np.flatnonzero(gain[np.arange(n), top] > best + 1e-9)
                best[better] = gain[better, top[better]]
                feature[first + better], threshold[first + better] = j, e[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        logit += value[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model
