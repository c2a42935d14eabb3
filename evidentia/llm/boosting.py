"""Gradient-boosted trees of depth two for a yes-no label, on arrays in memory."""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    all_g, all_h = g.sum(), h.sum()
    base = all_g**2 / (all_h + 1.0)
    for f, own in enumerate(cuts):
        if not len(own):
            continue
        bins = np.searchsorted(own, x[:, f], side="left")
        lg = np.cumsum(np.bincount(bins, weights=g, minlength=len(own) + 1))[:-1]
        lh = np.cumsum(np.bincount(bins, weights=h, minlength=len(own) + 1))[:-1]
        gain = lg**2 / (lh + 1.0) + (all_g - lg) ** 2 / (all_h - lh + 1.0) - base
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(own[k]))
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> dict:
    """A model as plain numbers; on one class only, a model that always says it."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model: dict = {"start": float(np.log(p / (1 - p))), "trees": []}
    if len(y) < 4 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 32))) for c in x.T]
    score = np.full(len(y), model["start"])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        gain, f, at = _split(x, g, h, cuts)
        if f < 0 or gain < 1e-6:
            break
        tree, leaves = [f, at], []
        for side in (x[:, f] <= at, x[:, f] > at):
            sg, f2, at2 = _split(x[side], g[side], h[side], cuts) if side.sum() > 8 else (0.0, -1, 0.0)
            if f2 < 0:
                v = float(rate * g[side].sum() / (h[side].sum() + 1.0))
                leaves.append((0, np.inf, v, v))
                continue
            low = side & (x[:, f2] <= at2)
            high = side & ~low
            leaves.append((f2, at2, *(float(rate * g[s].sum() / (h[s].sum() + 1.0)) for s in (low, high))))
        tree.append(leaves)
        model["trees"].append(tree)
        score += _tree(tree, x)
    return model


def _tree(tree: list, x: np.ndarray) -> np.ndarray:
    f, at, (a, b) = tree
    low = np.where(x[:, a[0]] <= a[1], a[2], a[3])
    high = np.where(x[:, b[0]] <= b[1], b[2], b[3])
    return np.where(x[:, f] <= at, low, high)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """The chance of yes for each row."""
    score = np.full(len(x), model["start"])
    for tree in model["trees"]:
        score += _tree(tree, x)
    return 1 / (1 + np.exp(-score))


def scorer(model: dict, accept: float = 0.5):
    """A yes-no function of one row as a list, for callers that judge row by row."""
    start, trees = model["start"], model["trees"]
    need = float(np.log(accept / (1 - accept)))

    def judge(x: list[float]) -> bool:
        score = start
        for f, at, (a, b) in trees:
            f2, at2, low, high = a if x[f] <= at else b
            score += low if x[f2] <= at2 else high
        return score >= need

    return judge
