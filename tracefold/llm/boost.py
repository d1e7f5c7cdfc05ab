"""Gradient-boosted trees: trained with numpy on a bounded table, scored as plain SQL."""

from __future__ import annotations

import numpy as np

#: A tree is a leaf value or (feature, threshold, left, right): left where the feature is at most the threshold.
Tree = float | tuple


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> Tree:
    best, at = 1e-6, None
    total_g, total_h = g.sum(), h.sum()
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(ch[cut] >= least) & (total_h - ch[cut] >= least)]
            if cut.size:
                gain = cg[cut] ** 2 / (ch[cut] + l2) + (total_g - cg[cut]) ** 2 / (total_h - ch[cut] + l2) - total_g**2 / (total_h + l2)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, at = gain[i], (f, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    if at is None:
        return float(-total_g / (total_h + l2))
    f, t = at
    left = x[:, f] <= t
    return f, t, _grow(x[left], g[left], h[left], depth - 1, least, l2), _grow(x[~left], g[~left], h[~left], depth - 1, least, l2)


def _score(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _score(left, x), _score(right, x))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0, l2: float = 1.0) -> list[Tree]:
    """Trees whose sum is the log-odds of y = 1."""
    trees: list[Tree] = []
    z = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, p - y, p * (1 - p), depth, least, l2)
        trees.append(_scale(tree, rate))
        z += _score(trees[-1], x)
    return trees


def _scale(tree: Tree, rate: float) -> Tree:
    return (*tree[:2], _scale(tree[2], rate), _scale(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def log_odds(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((_score(t, x) for t in trees), np.zeros(len(x)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a z + b))), by Newton steps on held-out rows."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-2, (w * z).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def as_sql(trees: list[Tree], names: list[str]) -> str:
    """The sum of the trees as a SQL expression over the columns `names`."""

    def node(t: Tree) -> str:
        if not isinstance(t, tuple):
            return f"{t:.6f}D"
        f, cut, left, right = t
        return f"CASE WHEN {names[f]} <= {cut:.6f}D THEN {node(left)} ELSE {node(right)} END"

    return " + ".join(f"({node(t)})" for t in trees) or "0D"
