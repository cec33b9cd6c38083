"""Histogram trees: growing, gradient boosting and random forests, flattened into arrays.

A model is a few flat arrays over all nodes of all trees.  Prediction steps every row through every tree at
once by table lookup, as often as the deepest tree is deep; leaves lead to themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Flat:
    root: np.ndarray  # node of each tree's root
    feature: np.ndarray
    cut: np.ndarray  # to the left if value <= cut; NaN goes right
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float = 0.0

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.tile(self.root, (len(part), 1))
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[a : a + 4096] = self.value[at].sum(axis=1)
        return out + self.base


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, BINS)[1:-1], method="lower")) if np.isfinite(c).any() else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, edges)], axis=1).astype(np.int64)


def grow(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, columns: int, rng: np.random.Generator, out: list) -> None:
    """Append one tree's nodes to out: [feature, cut, left, right, value]; gains are those of second-order boosting."""
    width = BINS
    node = np.full(len(b), len(out))
    out.append([0, 0.0, len(out), len(out), 0.0])
    level = [len(out) - 1]
    for d in range(depth + 1):
        slot = np.full(len(out), -1)
        slot[level] = np.arange(len(level))
        s = slot[node]
        rows = np.flatnonzero(s >= 0)
        gs, hs = np.bincount(s[rows], g[rows], len(level)), np.bincount(s[rows], h[rows], len(level))
        for k, n in enumerate(level):
            out[n][4] = gs[k] / (hs[k] + ridge)
        if d == depth:
            return
        best = np.full(len(level), 1e-9)
        how = np.full((len(level), 2), -1)
        allowed = np.zeros((len(level), b.shape[1]), bool)
        for k in range(len(level)):
            allowed[k, rng.choice(b.shape[1], columns, replace=False)] = True
        for f in range(b.shape[1]):
            if len(edges[f]) == 0 or not allowed[:, f].any():
                continue
            key = s[rows] * width + b[rows, f]
            gl = np.bincount(key, g[rows], len(level) * width).reshape(-1, width).cumsum(axis=1)
            hl = np.bincount(key, h[rows], len(level) * width).reshape(-1, width).cumsum(axis=1)
            gl, hl = gl[:, : len(edges[f])], hl[:, : len(edges[f])]
            gr, hr = gs[:, None] - gl, hs[:, None] - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
            gain[(hl < least) | (hr < least) | ~allowed[:, f, None]] = -np.inf
            at = gain.argmax(axis=1)
            top = gain[np.arange(len(level)), at]
            better = top > best
            best[better], how[better] = top[better], np.stack([np.full(len(level), f), at], axis=1)[better]
        following = []
        for k, n in enumerate(level):
            if how[k, 0] < 0:
                continue
            f, c = how[k]
            out[n][:4] = [int(f), float(edges[f][c]), len(out), len(out) + 1]
            mine = rows[s[rows] == k]
            node[mine] = np.where(b[mine, f] <= c, len(out), len(out) + 1)
            following += [len(out), len(out) + 1]
            out += [[0, 0.0, len(out), len(out), 0.0], [0, 0.0, len(out) + 1, len(out) + 1, 0.0]]
        level = following
        if not level:
            return


def _flat(roots: list[int], nodes: list, depth: int, base: float, scale: float) -> Flat:
    f, c, l, r, v = zip(*nodes)  # noqa: E741
    return Flat(np.array(roots), np.array(f, np.int32), np.array(c), np.array(l, np.int32), np.array(r, np.int32), np.array(v) * scale, depth, base)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0, seed: int = 7) -> Flat:
    """Gradient-boosted trees for the log-odds of y = 1."""
    rng, edges = np.random.default_rng(seed), edges_of(x)
    b = binned(x, edges)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(len(y), base)
    nodes, roots = [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        roots.append(len(nodes))
        grow(b, edges, y - p, p * (1 - p), depth, least, ridge, x.shape[1], rng, nodes)
        one = _flat(roots[-1:], nodes, depth, 0.0, rate)
        f += one.sums(x)
    return _flat(roots, nodes, depth, base, rate)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 10, least: float = 2.0, seed: int = 7) -> Flat:
    """Random forest: bootstrap rows, a square root of the features at each node; sums() is the mean share of y = 1."""
    rng, edges = np.random.default_rng(seed), edges_of(x)
    b = binned(x, edges)
    nodes, roots = [], []
    columns = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        roots.append(len(nodes))
        grow(b[at], edges, y[at].astype(float), np.ones(len(at)), depth, least, 1e-6, columns, rng, nodes)
    return _flat(roots, nodes, depth, 0.0, 1 / trees)


def chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds))
