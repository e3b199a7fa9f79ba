"""Gradient-boosted trees for a binary label over dense features, with isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np

#: Bins of a feature, least weight of a side of a split, and shrinkage of leaf values.
BINS, LEAST, SHRINK = 64, 0.5, 1.0


class Trees:
    """Trees of equal depth as arrays: a feature and a cut for each inner node, a value for each leaf."""

    def __init__(self, depth: int, bias: float):
        self.depth, self.bias = depth, bias
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.at, self.levels = np.zeros(1), np.zeros(1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        for features, cuts, values in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            out += values[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a little of the raw margin keeps the order within a calibrated step."""
        m = self.margin(x)
        return 0.998 * np.interp(m, self.at, self.levels) + 0.002 / (1 + np.exp(-np.clip(m, -30, 30)))


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing least-squares fit: positions and levels, pooled from violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([v, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, hi = blocks.pop()
            v1, n1, lo, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
    at, levels = [], []
    for v, _, lo, hi in blocks:
        at += [lo, hi]
        levels += [v, v]
    return np.array(at), np.array(levels)


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, weight: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15) -> Trees:
    """calibrate marks the rows that fit the isotonic step instead of the trees; weight says how many rows of the whole each stands for.
    Without both classes the score is constant."""
    prior = float(np.clip(np.average(y, weights=weight) if len(y) else 0.0, 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(prior / (1 - prior))))
    model.at, model.levels = np.array([0.0]), np.array([prior])
    train = ~calibrate
    if len(np.unique(y[train])) < 2 or len(np.unique(y[calibrate])) < 2:
        return model
    xt, yt, wt = x[train], y[train], weight[train] / weight[train].mean()
    edges = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, xt[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(yt), model.bias)
    n_nodes = 2**depth - 1
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = wt * (yt - p), wt * p * (1 - p)
        node = np.zeros(len(yt), np.int64)
        features, cuts = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            where = np.full(width, -1)
            picked = np.zeros(width, np.int64)
            g_all, h_all = np.bincount(local, grad, width), np.bincount(local, hess, width)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                g = np.bincount(local * k + binned[:, f], grad, width * k).reshape(width, k).cumsum(1)[:, :-1]
                h = np.bincount(local * k + binned[:, f], hess, width * k).reshape(width, k).cumsum(1)[:, :-1]
                gain = g**2 / (h + SHRINK) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + SHRINK) - (g_all**2 / (h_all + SHRINK))[:, None]
                gain[(h < LEAST) | (h_all[:, None] - h < LEAST)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], where[better], picked[better] = value[better], top[better], f
            for i in range(width):
                if where[i] >= 0:
                    features[first + i], cuts[first + i] = picked[i], edges[picked[i]][where[i]]
            node = 2 * node + 1 + (xt[np.arange(len(xt)), features[node]] > cuts[node])
        leaf = node - n_nodes
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        values = rate * g / (h + SHRINK)
        margin += values[leaf]
        model.features.append(features)
        model.cuts.append(cuts)
        model.values.append(values)
    model.at, model.levels = isotonic(model.margin(x[calibrate]), y[calibrate], weight[calibrate])
    return model
