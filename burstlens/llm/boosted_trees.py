"""Gradient-boosted trees for two classes, with monotonic constraints, in numpy.

Trees are grown on binned features, level by level, by the gain of the logistic loss. A
feature with a direction may only be split so that the side with larger values scores
not lower (+1) or not higher (-1); the middle between both sides bounds everything
below them, so the whole model keeps the direction. All trees are flattened into five
arrays, and rows are scored by walking all of them down one level at a time.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

ROUNDS, DEPTH, RATE, BINS = 80, 4, 0.15, 48
LEAST_WEIGHT, SHRINK = 5.0, 1.0


def _value(g, h, lo, hi):
    return np.clip(-g / (h + SHRINK), lo, hi)


def _gain(g, h, v):
    return -(g * v + 0.5 * (h + SHRINK) * v * v)


def _best_split(binned, g, h, edges, direction, lo, hi):
    """Gain, feature and bin of the best allowed split of some rows, or None."""
    best, total_g, total_h = None, g.sum(), h.sum()
    whole = _gain(total_g, total_h, _value(total_g, total_h, lo, hi))
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        gl = np.cumsum(np.bincount(binned[:, f], g, len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, len(cuts) + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        vl, vr = _value(gl, hl, lo, hi), _value(gr, hr, lo, hi)
        gain = _gain(gl, hl, vl) + _gain(gr, hr, vr) - whole
        allowed = (hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT) & (direction[f] * (vr - vl) >= 0)
        gain = np.where(allowed, gain, -1.0)
        b = int(np.argmax(gain))
        if gain[b] > 1e-6 and (best is None or gain[b] > best[0]):
            best = (gain[b], f, b, vl[b], vr[b])
    return best


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], rounds: int = ROUNDS) -> SimpleNamespace:
    """A model for the chance of ``y`` = 1; made of plain arrays, so it can be broadcast."""
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], levels)) for f in range(x.shape[1])]
    binned = np.stack(
        [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1
    )
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        at = len(value)
        for column, x0 in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, v)):
            column.append(x0)
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        root = node(float(_value(g.sum(), h.sum(), -np.inf, np.inf)))
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for _ in range(DEPTH):
            grown = []
            for at, rows, lo, hi in open_nodes:
                best = _best_split(binned[rows], g[rows], h[rows], edges, direction, lo, hi)
                if best is None:
                    continue
                _, f, b, vl, vr = best
                feature[at], cut[at] = f, float(edges[f][b])
                left[at], right[at] = node(float(vl)), node(float(vr))
                middle = (vl + vr) / 2
                bounds_l, bounds_r = (lo, hi), (lo, hi)
                if direction[f] > 0:
                    bounds_l, bounds_r = (lo, middle), (middle, hi)
                elif direction[f] < 0:
                    bounds_l, bounds_r = (middle, hi), (lo, middle)
                side = binned[rows, f] <= b
                grown += [(left[at], rows[side], *bounds_l), (right[at], rows[~side], *bounds_r)]
            open_nodes = grown
        tree = SimpleNamespace(
            feature=np.array(feature), cut=np.array(cut), left=np.array(left),
            right=np.array(right), value=np.array(value), roots=np.array([root]),
        )
        score += RATE * _leaves(tree, x)
    return SimpleNamespace(
        base=base, feature=np.array(feature, np.int32), cut=np.array(cut),
        left=np.array(left, np.int32), right=np.array(right, np.int32),
        value=RATE * np.array(value), roots=np.array(roots, np.int32),
    )


def _leaves(model, x: np.ndarray) -> np.ndarray:
    """The sum of the leaf values that each row comes to."""
    at = np.tile(model.roots, (len(x), 1))
    row = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        down = x[row, model.feature[at]] <= model.cut[at]
        at = np.where(down, model.left[at], model.right[at])
    return model.value[at].sum(axis=1)


def score(model, x: np.ndarray) -> np.ndarray:
    """The chance of class 1 for each row."""
    return 1 / (1 + np.exp(-(model.base + _leaves(model, x))))
