"""Gradient-boosted trees with logistic loss on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth: per tree, inner nodes hold a feature and a threshold, leaves a value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    slope: float = 1.0  # Platt scaling
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Second-order boosting; each split takes the best gain over histogram bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for at in range(depth):
            first, count = 2**at - 1, 2**at
            own = node - first
            best = np.zeros(count)
            split = [(0, -1)] * count
            for j in range(width):
                k = len(edges[j]) + 1
                key = own * k + codes[:, j]
                g = np.bincount(key, grad, count * k).reshape(count, k).cumsum(1)
                h = np.bincount(key, hess, count * k).reshape(count, k).cumsum(1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
                gain[:, -1] = 0
                top = gain.argmax(1)
                for c in range(count):
                    if gain[c, top[c]] > best[c] + 1e-9:
                        best[c], split[c] = gain[c, top[c]], (j, top[c])
            went = np.zeros(n, np.int64)
            for c, (j, cut) in enumerate(split):
                here = own == c
                if cut >= 0:
                    feature[first + c], threshold[first + c] = j, edges[j][cut]
                    went[here] = x[here, j] > edges[j][cut]
            node = 2 * node + 1 + went
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = -rate * g / (h + l2)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Boosted:
    """Platt scaling by Newton steps on rows that the trees have not seen."""
    m = model.margin(x)
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * m).sum(), d.sum()])
        hess = np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(a), float(b)
    return model
