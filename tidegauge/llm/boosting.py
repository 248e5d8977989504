"""Gradient-boosted trees on a few dense features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidegauge.llm.labelled import binned, quantile_cuts


@dataclass
class Trees:
    """Complete binary trees of one depth: inner nodes in level order, then leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.start)
        rows = np.arange(len(values))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(values), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (values[rows, feature[node]] > cut[node])
            out += leaf[node - (2**depth - 1)]
        return out


def fit_trees(
    values: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32,
    shrink: float = 2.0,
) -> Trees:
    """Boost on logistic loss with second-order gains over quantile bins."""
    cuts = quantile_cuts(values, bins)
    at = binned(values, cuts)
    n, width = values.shape
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Trees(
        np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)),
        float(np.log(prior / (1 - prior))),
    )
    margin = np.full(n, model.start)
    offset = np.arange(width) * bins
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * bins) + offset + at).ravel()
            size = count * width * bins
            g = np.bincount(flat, np.repeat(grad, width), size).reshape(count, width, bins).cumsum(2)
            h = np.bincount(flat, np.repeat(hess, width), size).reshape(count, width, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + shrink) + (all_g - g) ** 2 / (all_h - h + shrink) - all_g**2 / (all_h + shrink)
            gain[:, :, -1] = 0
            best = gain.reshape(count, -1).argmax(1)
            feature, place = best // bins, best % bins
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            cut = np.where(useful & (place < bins - 1), cuts[feature, np.minimum(place, bins - 2)], np.inf)
            model.feature[t, first : first + count], model.cut[t, first : first + count] = feature, cut
            own = node - first
            node = 2 * node + 1 + (values[np.arange(n), feature[own]] > cut[own])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        model.leaf[t] = -rate * g / (h + shrink)
        margin += model.leaf[t][leaf]
    return model


@dataclass
class Isotonic:
    """A rising curve from margins to probabilities, straight between the pooled blocks."""

    x: np.ndarray
    p: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.p)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; one example of each class is added at the ends, so no block is quite sure."""
    if not len(margin):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, label in zip(margin[order], y[order]):
        blocks.append([float(m), float(label), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x = np.array([m / n for m, _, n in blocks])
    p = np.array([(s + 0.5) / (n + 1) for _, s, n in blocks])
    return Isotonic(x, np.maximum.accumulate(p))
