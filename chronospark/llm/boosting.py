"""Gradient-boosted trees over dense features and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting with histogram splits. Trees are complete, of one depth, stored as arrays."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    ridge: float = 1.0
    least: float = 2.0
    base: float = 0.0
    model: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.model = float(np.log(p0 / (1 - p0))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cuts = [np.unique(np.concatenate([c, [0.0]])) for c in cuts]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node, split_on, split_at = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, 1e-9)
                feat, cut, rank = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, 1 << 30)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    width = len(c) + 1
                    key = node * width + binned[:, f]
                    g = np.bincount(key, grad, n * width).reshape(n, width)
                    h = np.bincount(key, hess, n * width).reshape(n, width)
                    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better], feat[better], cut[better], rank[better] = top[better], f, c[at[better]], at[better]
                split_on.append(feat)
                split_at.append(cut)
                node = node * 2 + (binned[np.arange(len(y)), feat[node]] > rank[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            raw += value[node]
            self.model.append((split_on, split_at, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split_on, split_at, value in self.model:
            node = np.zeros(len(x), dtype=np.int64)
            for feat, cut in zip(split_on, split_at, strict=True):
                node = node * 2 + (x[rows, feat[node]] > cut[node])
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function nearest to y, as points (mean score, mean y) of its blocks."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([float(s), float(t), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    n = np.array([b[2] for b in blocks])
    return np.array([b[0] for b in blocks]) / n, (np.array([b[1] for b in blocks]) + 0.01) / (n + 0.02)
