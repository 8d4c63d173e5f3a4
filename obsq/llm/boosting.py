"""Gradient-boosted trees as flat numpy arrays, with monotonic constraints.

Fitted on the driver from a bounded sample; scored inside tasks, whole batches
at a time. A tree is stored as a heap: node i has the children 2i+1 and 2i+2.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  # (trees, nodes) int16, -1 at a leaf
    threshold: np.ndarray  # (trees, nodes), rows above it go right
    value: np.ndarray  # (trees, nodes), log-odds added at a leaf
    base: float
    depth: int


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut points half-way between neighbouring quantiles; none for a constant."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 48,
    min_rows: int = 5,
    l2: float = 1.0,
) -> Forest:
    """Boost logistic loss over histograms of each feature.

    ``monotone`` has +1 for features the score may only rise with, -1 for those
    it may only fall with, 0 for free ones. A split that breaks a constraint is
    not considered, and the children of a constrained split are kept on their
    sides of its middle value, so that the constraint holds for whole trees. With
    one class or no rows the forest is a constant.
    """
    n, f = x.shape
    nodes = 2 ** (depth + 1) - 1
    sign = np.zeros(f) if monotone is None else np.asarray(monotone, float)
    mean = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    feature = np.full((trees, nodes), -1, np.int16)
    threshold = np.zeros((trees, nodes))
    value = np.zeros((trees, nodes))
    if not n or y.min() == y.max():
        return Forest(feature, threshold, value, base, depth)
    edges = [_edges(x[:, j], bins) for j in range(f)]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    raw = np.full(n, base)
    for t in range(trees):
        p = _sigmoid(raw)
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        value[t, 0] = np.clip(g.sum() / (h.sum() + l2), -5, 5)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            # rows that stopped at a leaf further up take no part
            live = at >= first
            local = at[live] - first
            gl, hl = g[live], h[live]
            best = np.full(width, 1e-6)
            cut = [None] * width
            for j in range(f):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                key = local * size + binned[j][live]
                sums = [
                    np.bincount(key, w, width * size).reshape(width, size).cumsum(1)
                    for w in (gl, hl, np.ones(len(gl)))
                ]
                (left_g, left_h, left_n) = (s[:, :-1] for s in sums)
                (all_g, all_h, all_n) = (s[:, -1:] for s in sums)
                right_g, right_h = all_g - left_g, all_h - left_h
                bound = (low[first : first + width, None], high[first : first + width, None])
                wl = np.clip(left_g / (left_h + l2), *bound)
                wr = np.clip(right_g / (right_h + l2), *bound)
                gain = (
                    2 * wl * left_g - wl**2 * (left_h + l2)
                    + 2 * wr * right_g - wr**2 * (right_h + l2)
                    - all_g**2 / (all_h + l2)
                )
                ok = (left_n >= min_rows) & (all_n - left_n >= min_rows)
                if sign[j]:
                    ok &= sign[j] * (wr - wl) >= 0
                gain = np.where(ok, gain, -np.inf)
                k = gain.argmax(1)
                for node in range(width):
                    if gain[node, k[node]] > best[node]:
                        best[node] = gain[node, k[node]]
                        cut[node] = (j, k[node], wl[node, k[node]], wr[node, k[node]])
            for node, found in enumerate(cut):
                if found is None:
                    continue
                here = first + node
                j, k, wl, wr = found
                feature[t, here], threshold[t, here] = j, edges[j][k]
                kids = (2 * here + 1, 2 * here + 2)
                value[t, kids[0]], value[t, kids[1]] = wl, wr
                for kid in kids:
                    low[kid], high[kid] = low[here], high[here]
                if sign[j]:
                    middle = (wl + wr) / 2
                    if sign[j] > 0:
                        high[kids[0]], low[kids[1]] = middle, middle
                    else:
                        low[kids[0]], high[kids[1]] = middle, middle
                rows = np.flatnonzero(at == here)
                at[rows] = np.where(binned[j][rows] > k, kids[1], kids[0])
        value[t] *= rate
        raw += value[t, at]
    return Forest(feature, threshold, value, base, depth)


def raw_scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Log-odds of every row of ``x``."""
    rows = np.arange(len(x))
    total = np.full(len(x), forest.base)
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        at = np.zeros(len(x), np.int64)
        for _ in range(forest.depth):
            j = feature[at]
            down = 2 * at + 1 + (x[rows, np.maximum(j, 0)] > threshold[at])
            at = np.where(j < 0, at, down)
        total += value[at]
    return total


def probabilities(forest: Forest, x: np.ndarray) -> np.ndarray:
    return _sigmoid(raw_scores(forest, x))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function closest to ``y``, by pooling neighbours."""
    order = np.argsort(scores, kind="stable")
    # equal scores get one value
    points, inverse = np.unique(scores[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y[order]) / weight
    pools: list[list[float]] = []
    for x, m, w in zip(points, mean, weight):
        pools.append([x, x, m, w])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, last, m1, w1 = pools.pop()
            pools[-1][1] = last
            m0, w0 = pools[-1][2:]
            pools[-1][2:] = [(m0 * w0 + m1 * w1) / (w0 + w1), w0 + w1]
    xs = np.array([v for p in pools for v in p[:2]])
    return xs, np.array([v for p in pools for v in (p[2], p[2])])


def calibrate(points: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    xs, ys = points
    if not len(xs):
        return _sigmoid(scores)
    return np.clip(np.interp(scores, xs, ys), 0.0, 1.0)
