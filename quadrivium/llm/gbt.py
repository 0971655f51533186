"""Histogram gradient-boosted trees in numpy, flattened for vectorised traversal.

Training runs on the driver over a bounded sample of feature rows.  A fitted
ensemble is three arrays of shape (trees, 2**(depth+1)-1): split feature,
threshold and leaf value, children of node i at 2i+1 and 2i+2.  Scoring walks
all rows of a batch down one level at a time, so cost per row is
trees x depth array look-ups with no Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: int = 12, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss with per-level histograms.

    A split sends bin <= b left; its threshold is the b-th quantile edge. A node
    without a gaining split keeps threshold +inf, so all its rows go left.
    """
    n, width = x.shape if x.size else (0, x.shape[1] if x.ndim == 2 else 1)
    nodes = 2 ** (depth + 1) - 1
    prior = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    base = float(np.log(prior / (1 - prior)))
    if n < 2 or y.min() == y.max():
        return Forest(np.zeros((0, nodes), np.int32), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    least = min(least, max(1, n // 20))
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        feature = np.zeros(nodes, dtype=np.int32)
        threshold = np.full(nodes, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            choice = np.zeros(count, dtype=np.int64)
            at = np.full(count, -1, dtype=np.int64)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                g, h, c = (np.bincount(key, w, count * bins).reshape(count, bins).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g * g / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt * gt / (ht + ridge)
                gain[(c < least) | (ct - c < least)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                best[better], choice[better], at[better] = gain[np.arange(count), top][better], j, top[better]
            split = at >= 0
            feature[first : first + count] = choice
            threshold[first : first + count][split] = [edges[j][b] for j, b in zip(choice[split], at[split], strict=True)]
            right = split[local] & (binned[np.arange(n), choice[local]] > at[local])
            node = 2 * node + 1 + right
        g, h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
        value = -rate * g / (h + ridge)
        margin += value[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base, depth)


@dataclass(frozen=True)
class Isotonic:
    """Monotone step calibration; linear between the centres of the fitted blocks."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        # A sliver of the raw score keeps the order inside flat blocks.
        return np.clip(0.999 * np.interp(p, self.x, self.y) + 0.001 * p, 0.0, 1.0) if len(self.x) else p


def isotonic(p: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over scores sorted ascending; equal scores are pooled first."""
    if not len(p):
        return Isotonic(np.zeros(0), np.zeros(0))
    unique, inverse = np.unique(p, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # label sum, weight, score sum
    for u, w, t in zip(unique, weight, total, strict=True):
        blocks.append([t, w, u * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    return Isotonic(sums[:, 2] / sums[:, 1], sums[:, 0] / sums[:, 1])
