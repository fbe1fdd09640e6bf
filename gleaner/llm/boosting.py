"""Histogram gradient-boosted trees in numpy.

Features are cut into at most 64 bins by quantiles; a tree grows leaf by leaf
where the gain is largest, with histograms of gradients and the subtraction
trick.  A fitted model is a few flat arrays, and scoring walks all trees of all
rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees, (trees, nodes).  A leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            go_left = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(go_left, self.left[trees, at], self.right[trees, at])
        raw = self.base + self.value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, leaves: int = 12, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Forest:
    """Fit to labels 0 and 1 by logistic loss.  Without rows, or with one label only, the score is constant."""
    n, width = x.shape
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else 0.0
    empty = np.zeros((0, 1), np.int32)
    if not n or ones in (0.0, float(n)):
        return Forest(base, empty, empty.astype(float), empty, empty, empty.astype(float), 0)
    cuts = []
    for f in range(width):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(values)
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.int64)
    flat = binned + np.arange(width) * bins
    size = 2 * leaves - 1
    shape = (trees, size)
    feature, left, right = (np.zeros(shape, np.int32) for _ in range(3))
    threshold, value = np.zeros(shape), np.zeros(shape)
    left[:] = right[:] = np.arange(size)
    raw, deepest = np.full(n, base), 1

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = flat[rows].ravel()
        out = np.empty((3, width, bins))
        for k, w in enumerate((np.repeat(g[rows], width), np.repeat(h[rows], width), None)):
            out[k] = np.bincount(at, w, width * bins).reshape(width, bins)
        return out

    def best(hist: np.ndarray) -> tuple[float, int, int]:
        run = hist.cumsum(axis=2)
        total = run[:, :1, -1:]
        gl, hl, nl = run
        gr, hr, nr = total - run
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
        gain[(nl < least) | (nr < least)] = -1
        k = int(gain.argmax())
        return float(gain.flat[k]), *divmod(k, bins)

    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        rows = [np.arange(n)]
        hists = [histogram(rows[0], g, h)]
        splits, nodes, depth, used = [best(hists[0])], [0], [0], 1
        while len(rows) < leaves:
            k = max(range(len(splits)), key=lambda i: splits[i][0])
            gain, f, b = splits[k]
            if gain <= 1e-6 or b >= len(cuts[f]):
                break
            node, own = nodes[k], rows[k]
            goes = binned[own, f] <= b
            parts = (own[goes], own[~goes])
            small = int(len(parts[1]) < len(parts[0]))
            new = [None, None]
            new[small] = histogram(parts[small], g, h)
            new[1 - small] = hists[k] - new[small]
            feature[t, node], threshold[t, node] = f, cuts[f][b]
            left[t, node], right[t, node] = used, used + 1
            d = depth[k] + 1
            deepest = max(deepest, d)
            rows[k], hists[k], splits[k], nodes[k], depth[k] = parts[0], new[0], best(new[0]), used, d
            rows.append(parts[1])
            hists.append(new[1])
            splits.append(best(new[1]))
            nodes.append(used + 1)
            depth.append(d)
            used += 2
        for own, node in zip(rows, nodes, strict=True):
            step = rate * g[own].sum() / (h[own].sum() + l2)
            value[t, node] = step
            raw[own] += step
    return Forest(base, feature, threshold, left, right, value, deepest)
