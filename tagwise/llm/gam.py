"""A generalised additive model with pairwise interactions, learnt by cyclic boosting of shallow trees.

Every feature is cut into quantile bins once. In each round, feature after feature gets one small tree over its bins,
fitted to the logistic loss' gradients; a tree's leaf values are added to the feature's lookup table. Then the pairs of
features whose residuals gain most from a joint split get tables over coarser bins, boosted in the same cyclic way. A
score is the logistic function of the intercept plus one table entry per feature and pair: look-ups and additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
COARSE = 8


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            total += values[a, np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Values per bin of a tree of at most ``depth`` levels over ordered bins."""
    _, at = _best_split(g, h, ridge) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one axis once and each side once along the other."""
    best = (0.0, np.full(g.shape, -g.sum() / (h.sum() + ridge)))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            gain, sides = 0.0, []
            for part in (slice(None, at), slice(at, None)):
                across, weight = a[part].sum(axis=0), b[part].sum(axis=0)
                here, cut = _best_split(across, weight, ridge)
                gain += here + across.sum() ** 2 / (weight.sum() + ridge)
                row = np.empty(len(across))
                for x in (slice(None, cut), slice(cut, None)):
                    if across[x].size:
                        row[x] = -across[x].sum() / (weight[x].sum() + ridge)
                sides.append(np.tile(row, (len(a[part]), 1)))
            if gain > best[0]:
                values = np.concatenate(sides)
                best = (gain, values.T if turned else values)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15,
    depth: int = 2, ridge: float = 5.0,
) -> Model:
    """Learn from a matrix of features and labels 0 or 1; with no or one-sided labels all scores are the smoothed share."""
    n, width = x.shape
    prior = (y.sum() + 1) / (n + 2)
    start = float(np.log(prior / (1 - prior)))
    edges = [_edges(x[:, f], BINS) if n else np.empty(0) for f in range(width)]
    coarse = [_edges(x[:, f], COARSE) if n else np.empty(0) for f in range(width)]
    model = Model(start, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    total = np.full(n, start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), depth, ridge)
            model.tables[f] += step
            total += step[bins[f]]
    few = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]

    def grid(i: int, j: int, weight: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(few[i] * shape[1] + few[j], weight, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(
        ((_pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(width) for j in range(i)), reverse=True
    )
    model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1]
            values += step
            total += step[few[i], few[j]]
    return model
