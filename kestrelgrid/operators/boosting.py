"""Boosted shallow trees over binned features, fitted within one task and scored as vectorised look-ups.

The rows of one model are bounded by the caller; models are small, so that many are fitted side by side and
sent to the scoring tasks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np

#: Bins of a feature, L2 weight of a leaf, least sum of second derivatives in a leaf, rounds without gain after which fitting stops.
BINS, L2, LEAST_HESSIAN, PATIENCE = 64, 1.0, 1.0, 30
#: Shares of the rows and of the features that a tree sees.
ROW_SHARE, FEATURE_SHARE = 0.7, 0.7


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Trees:
    """Complete binary trees: for each inner node a feature and the first bin of its right side; leaves' values; the gain of each feature."""

    base: float
    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            out += leaf[_walk(binned, rows, feature, split)]
        return out


def _walk(binned: np.ndarray, rows: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The leaf of every row; node k has the children 2k + 1 and 2k + 2."""
    node = np.zeros(len(rows), np.int64)
    for _ in range(int(np.log2(len(feature) + 1))):
        node = 2 * node + 1 + (binned[rows, feature[node]] >= split[node])
    return node - len(feature)


def fit(x: np.ndarray, y: np.ndarray, depth: int, trees: int, rate: float, seed: int, held_out: np.ndarray | None = None) -> Trees:
    """Trees for labels 0 and 1; with ``held_out`` rows, as many as were best on them."""
    rng, (n, width) = np.random.default_rng(seed), x.shape
    learn = np.ones(n, bool) if held_out is None else ~held_out
    cuts = [np.unique(np.quantile(x[learn, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    share = np.clip(y[learn].mean(), 1e-6, 1 - 1e-6)
    inner = 2**depth - 1
    model = Trees(float(np.log(share / (1 - share))), cuts, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), np.zeros(width))
    binned, rows = model.bins(x), np.arange(n)
    margin, places, best = np.full(n, model.base), np.flatnonzero(learn), (np.inf, 0)
    features, splits, leaves = [], [], []
    for t in range(trees):
        p = _sigmoid(margin)
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        some = places[rng.random(len(places)) < ROW_SHARE]
        columns = np.sort(rng.choice(width, max(1, round(width * FEATURE_SHARE)), replace=False))
        feature, split, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(some), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * len(columns) + np.arange(len(columns))) * BINS + binned[some][:, columns]
            sums = [np.bincount(at.ravel(), np.repeat(v[some], len(columns)), count * len(columns) * BINS).reshape(count, len(columns), BINS).cumsum(axis=2) for v in (g, h)]
            (left_g, left_h), (all_g, all_h) = sums, (s[:, :, -1:] for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = -1
            flat = gain.reshape(count, -1)
            pick = flat.argmax(axis=1)
            for k in np.flatnonzero(flat[np.arange(count), pick] > 1e-9):
                c, b = divmod(int(pick[k]), BINS)
                feature[first + k], split[first + k] = columns[c], b + 1
                model.gain[columns[c]] += flat[k, pick[k]]
            node = 2 * node + 1 + (binned[some, feature[node]] >= split[node])
        ends = node - inner
        value = -rate * np.bincount(ends, g[some], inner + 1) / (np.bincount(ends, h[some], inner + 1) + L2)
        margin += value[_walk(binned, rows, feature, split)]
        features.append(feature)
        splits.append(split)
        leaves.append(value)
        if held_out is not None and held_out.any():
            q = np.clip(_sigmoid(margin[held_out]), 1e-15, 1 - 1e-15)
            loss = -np.mean(y[held_out] * np.log(q) + (1 - y[held_out]) * np.log(1 - q))
            if loss < best[0]:
                best = (loss, t + 1)
            elif t + 1 - best[1] >= PATIENCE:
                break
    keep = best[1] if held_out is not None and held_out.any() else len(features)
    model.feature, model.split, model.leaf = (np.array(v[:keep]).reshape(keep, -1) for v in (features, splits, leaves))
    return model


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the probability that fits margins best, by Newton's method with halved steps."""
    a, b = 1.0, 0.0
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    loss = lambda w: np.logaddexp(0, z @ w).sum() - (y * (z @ w)).sum() + 1e-6 * (w**2).sum()
    w = np.array([a, b])
    for _ in range(100):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2e-6 * np.eye(2), z.T @ (p - y) + 2e-6 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Calibrated:
    trees: Trees
    slope: float
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.trees.margin(x) + self.intercept) if len(x) else np.empty(0)

    def pack(self) -> bytes:
        return pickle.dumps(self)


def unpack(data: bytes) -> Calibrated:
    model = pickle.loads(data)  # noqa: S301  written by :meth:`Calibrated.pack`
    if not isinstance(model, Calibrated):
        raise ValueError("not a model")
    return model


def validation_rows(y: np.ndarray, u: np.ndarray, share: float) -> np.ndarray:
    """The first ``share`` of each class in the order of ``u``."""
    out = np.zeros(len(y), bool)
    for label in np.unique(y):
        mine = np.flatnonzero(y == label)
        out[mine[np.argsort(u[mine], kind="stable")][: round(len(mine) * share)]] = True
    return out


def calibrated(x: np.ndarray, y: np.ndarray, u: np.ndarray, depth: int, trees: int, rate: float, seed: int, early: bool, parts: int = 3, share: float = 0.1) -> Calibrated:
    """Trees on all rows, and a logistic curve on the margins that models of the other parts give each row.

    ``u``: a uniform number for each row, by which rows are dealt to parts and held out for early stopping.
    """
    part, margins = np.minimum((u * parts).astype(int), parts - 1), np.zeros(len(y))
    held = lambda rows: validation_rows(y[rows], (u[rows] * parts) % 1, share) if early else None
    for k in range(parts):
        rest, mine = part != k, part == k
        if mine.any():
            margins[mine] = fit(x[rest], y[rest], depth, trees, rate, seed, held(rest)).margin(x[mine])
    every = np.ones(len(y), bool)
    return Calibrated(fit(x, y, depth, trees, rate, seed, held(every)), *logistic_curve(margins, y))
