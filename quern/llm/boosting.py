"""Gradient-boosted trees for two classes, in numpy: binned features, logistic loss, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Trees of one depth as arrays: node k of a level leads to 2k and 2k+1 of the next."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, f[at]] > t[at])
            out += v[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 50, depth: int = 4, rate: float = 0.25, ridge: float = 2.0, least: float = 8.0) -> Forest:
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    n_inner, features = (1 << depth) - 1, x.shape[1]
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t, cut = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf), np.full(n_inner, BINS)
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            whole_g, whole_h = np.bincount(node, g, width), np.bincount(node, h, width)
            before = whole_g**2 / (whole_h + ridge)
            for j in range(features):
                if not len(edges[j]):
                    continue
                key = node * BINS + binned[:, j]
                left_g = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)[:, : len(edges[j])]
                left_h = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)[:, : len(edges[j])]
                right_g, right_h = whole_g[:, None] - left_g, whole_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - before[:, None]
                gain[(left_h < least / 4) | (right_h < least / 4)] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best).tolist():
                    best[k] = gain[k, at[k]]
                    f[width - 1 + k], t[width - 1 + k], cut[width - 1 + k] = j, edges[j][at[k]], at[k]
            at = width - 1 + node
            node = 2 * node + (binned[np.arange(len(y)), f[at]] > cut[at])
        leaves = 1 << depth
        value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
        score += value[node]
        out_f.append(f), out_t.append(t), out_v.append(value)
    return Forest(base, depth, np.array(out_f), np.array(out_t), np.array(out_v))
