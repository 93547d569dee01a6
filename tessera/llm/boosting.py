"""Gradient-boosted trees for two classes, in numpy: binned features, trees grown level by level, log loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature and threshold of inner nodes, values of leaves

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, shrink: float = 1.0, least: float = 3.0) -> BoostedTrees:
        n, f = x.shape
        weight = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(f) * bins
        mean = np.average(y, weights=weight)
        model = cls(float(np.log(mean / (1 - mean))))
        score = np.full(n, model.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, p * (1 - p) * weight
            feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                k, size = 2**level, f * bins
                at = (node[:, None] * size + flat).ravel()
                sums = [np.bincount(at, np.repeat(v, f), k * size).reshape(k, f, bins).cumsum(2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
                gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
                for j, e in enumerate(edges):
                    gain[:, j, len(e) :] = 0
                best = gain.reshape(k, -1).argmax(1)
                for i in range(k):
                    j, b = divmod(int(best[i]), bins)
                    if gain[i, j, b] > 1e-9:
                        feature[k - 1 + i], limit[k - 1 + i] = j, edges[j][b]
                inner = k - 1 + node
                node = 2 * node + (x[np.arange(n), feature[inner]] > limit[inner])
            leaf_g, leaf_h = (np.bincount(node, v, 2**depth) for v in (g, h))
            value = -rate * leaf_g / (leaf_h + shrink)
            model.trees.append((feature, limit, value))
            score += value[node]
        return model

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (node < len(feature)).any():
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))
