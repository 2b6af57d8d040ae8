"""Generalised additive model with pairwise interactions, by cyclic boosting of shallow trees on binned features."""

from __future__ import annotations

import numpy as np

#: Bins of a feature, of a feature in a pair, rounds over all features, over all pairs, pairs, learning rate, ridge.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 48, 8, 80, 40, 8, 0.2, 4.0


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges at quantiles of the distinct values' distribution."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The best cut of a row of bins (left part's length) and what it gains."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps of a tree of this depth over a row of bins."""
    cut, _ = _split(g, h) if depth else (0, 0.0)
    if not cut:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps of a tree that cuts one axis, then each side along the other; the better of both orders, and its gain."""
    best, most = np.full(g.shape, -g.sum() / (h.sum() + RIDGE)), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out, gain = np.empty(a.shape), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                out[part] = _tree(pg, ph, 1)
                second, more = _split(pg, ph)
                gain += float(_gain(pg.sum(), ph.sum())) + more
            gain -= float(_gain(g.sum(), h.sum()))
            if gain > most:
                best, most = (out.T if turned else out), gain
    return best, most


class Gam:
    """Constant, one table a feature, and tables of pairs; a score is a sum of looked-up bins."""

    def __init__(self, edges: list[np.ndarray], pair_edges: list[np.ndarray], constant: float):
        self.edges, self.pair_edges, self.constant = edges, pair_edges, constant
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        for b, table in zip(self.bins(x, self.edges), self.tables, strict=True):
            z += table[b]
        coarse = self.bins(x, self.pair_edges)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[i], coarse[j]]
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of y (0 or 1) on the rows of x. Without rows every score is 0.5; equal inputs give equal models."""
    n, d = x.shape
    mean = float((y.sum() + 1) / (n + 2))
    model = Gam([_edges(x[:, k], BINS) for k in range(d)], [_edges(x[:, k], PAIR_BINS) for k in range(d)], float(np.log(mean / (1 - mean))))
    if not n:
        return model
    z = np.full(n, model.constant)
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.pair_edges)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(fine[k], g, size), np.bincount(fine[k], h, size))
            model.tables[k] += step
            z += step[fine[k]]

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return coarse[i] * shape[1] + coarse[j], shape

    g, h = slopes()
    ranked = []
    for i in range(d):
        for j in range(i):
            cell, (a, b) = cells(i, j)
            ranked.append((-_pair_tree(np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b))[1], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(ranked)[:PAIRS]]
    model.pair_tables = [np.zeros(cells(i, j)[1]) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            cell, (a, b) = cells(i, j)
            step = RATE * _pair_tree(np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b))[0]
            table += step
            z += step.ravel()[cell]
    return model
