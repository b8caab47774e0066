"""Histogram-grown regression trees for boosting, on a bounded sample in the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Split:
    """Rows with feature <= bound go to ``low``, the others to ``high``; a leaf has a value."""

    value: float = 0.0
    feature: int = -1
    bound: float = 0.0
    low: "Split | None" = None
    high: "Split | None" = None


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    if not len(x):
        return [np.empty(0) for _ in range(x.shape[1])]
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[:-1])) for k in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)


def grow_tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least_rows: int) -> tuple[Split, np.ndarray]:
    """A tree of second-order steps fitted to ``rows``, and its values for all rows."""
    out = np.zeros(len(binned))

    def split(r: np.ndarray, everyone: np.ndarray, level: int) -> Split:
        total_g, total_h = g[r].sum(), h[r].sum()
        best_gain, feature, at = 1e-6, -1, -1
        if level < depth and len(r) >= 2 * least_rows:
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[r, k]
                n, sg, sh = (np.bincount(b, w, len(cuts) + 1).cumsum()[:-1] for w in (None, g[r], h[r]))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < least_rows) | (len(r) - n < least_rows)] = -1
                if gain.max() > best_gain:
                    best_gain, feature, at = float(gain.max()), k, int(gain.argmax())
        if feature < 0:
            value = float(-total_g / (total_h + 1))
            out[everyone] = value
            return Split(value)
        low, all_low = binned[r, feature] <= at, binned[everyone, feature] <= at
        return Split(
            0.0, feature, float(edges[feature][at]), split(r[low], everyone[all_low], level + 1), split(r[~low], everyone[~all_low], level + 1)
        )

    return split(rows, np.arange(len(binned)), 0), out


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, least_rows: int, share: float = 1.0, seed: int = 17) -> tuple[float, list[Split]]:
    """Log odds to begin with, and boosted logistic trees (their values still to be times rate)."""
    p = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return prior, []
    edges = quantile_edges(x, bins)
    binned, rng, z, grown = to_bins(x, edges), np.random.default_rng(seed), np.full(len(y), prior), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-z))
        rows = np.arange(len(y)) if share >= 1 else np.sort(rng.permutation(len(y))[: max(2 * least_rows, int(len(y) * share))])
        tree, values = grow_tree(binned, edges, prob - y, prob * (1 - prob), rows, depth, least_rows)
        z += rate * values
        grown.append(tree)
    return prior, grown
