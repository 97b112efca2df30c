"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself on both sides."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for a matrix of rows by features: every row walks every tree at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting on histograms.

    ``monotone`` has +1, -1 or 0 for each feature: with the others fixed, the score may only
    rise, only fall, or do as it likes.  A split that breaks this is not taken, and the middle
    between its two sides bounds everything below it.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin > k means x > cuts[k]
    mean = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots: list[int] = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        value = float(np.clip(-sum_g / (sum_h + ridge), low, high)) * rate
        nodes.append([0, np.inf, here, here, value])
        best: tuple | None = None
        for f in range(x.shape[1]) if level < depth and len(rows) > 1 else ():
            n = len(cuts[f]) + 1
            lg = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
            lh = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
            rg, rh = sum_g - lg, sum_h - lh
            wl, wr = np.clip(-lg / (lh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
            gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - sum_g**2 / (sum_h + ridge)
            bad = (lh < least) | (rh < least) | (monotone[f] * (wr - wl) < 0)
            gain[bad] = -np.inf
            if len(gain) and gain.max() > 1e-9 and (best is None or gain.max() > best[0]):
                k = int(gain.argmax())
                best = (gain[k], f, k, wl[k], wr[k])
        if best:
            _, f, k, wl, wr = best
            goes = binned[rows, f] > k
            middle = (wl + wr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            left = grow(rows[~goes], g, h, level + 1, *bounds[0])
            right = grow(rows[goes], g, h, level + 1, *bounds[1])
            nodes[here] = [f, cuts[f][k], left, right, 0.0]
        return here

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = _flat(nodes, roots[-1:], depth, 0.0)
        node = np.full(len(y), roots[-1])
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), one.feature[node]] > one.threshold[node], one.right[node], one.left[node])
        score = score + one.value[node]
    return _flat(nodes, roots, depth, base)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, base: float) -> Trees:
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), depth, base)
