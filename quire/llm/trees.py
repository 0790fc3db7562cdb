"""Gradient-boosted regression trees for a yes-or-no label, in numpy.

Features are cut into at most ``BINS`` bins by quantiles, and every level of a
tree is grown for all its nodes at once from histograms of gradients.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Node i has children 2i + 1 (value <= cut) and 2i + 2; ``feature`` is -1 in a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            step = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(inner, step, at)

    def paths(self) -> list[tuple[tuple[int, str, float], ...]]:
        """Conditions (feature, "<=" or ">", cut) from the root to every node below it."""
        out, stack = [], [(0, ())]
        while stack:
            i, path = stack.pop()
            if path:
                out.append(path)
            if self.feature[i] >= 0:
                f, c = int(self.feature[i]), float(self.cut[i])
                stack += [(2 * i + 1, (*path, (f, "<=", c))), (2 * i + 2, (*path, (f, ">", c)))]
        return out


@dataclass
class Forest:
    base: float = 0.0
    rate: float = 0.2
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out


def _edges(x: np.ndarray) -> list[np.ndarray]:
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], levels, method="lower")) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.2, least: float = 1.0, penalty: float = 1.0, share: float = 1.0, seed: int = 7) -> Forest:
    """Forest of log-odds for labels 0 and 1; ``share`` of the rows is drawn for each tree."""
    rng = np.random.default_rng(seed)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(mean / (1 - mean))), rate)
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = binned.shape[1]
    place = binned + np.arange(width) * BINS
    margin = np.full(len(x), forest.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        used = rng.random(len(x)) < share if share < 1 else np.ones(len(x), dtype=bool)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth + 1):
            low, n = 2**level - 1, 2**level
            live = used & (at >= low)
            local = at[live] - low
            g, h = np.bincount(local, grad[live], n), np.bincount(local, hess[live], n)
            tree.value[low : low + n] = g / (h + penalty)
            if level == depth:
                break
            slot = (local[:, None] * (width * BINS) + place[live]).ravel()
            hg = np.bincount(slot, np.repeat(grad[live], width), n * width * BINS).reshape(n, width, BINS).cumsum(axis=2)
            hh = np.bincount(slot, np.repeat(hess[live], width), n * width * BINS).reshape(n, width, BINS).cumsum(axis=2)
            total_g, total_h = g[:, None, None], h[:, None, None]
            gain = hg**2 / (hh + penalty) + (total_g - hg) ** 2 / (total_h - hh + penalty) - total_g**2 / (total_h + penalty)
            gain[(hh < least) | (total_h - hh < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(n, -1).max(axis=1) > 1e-6):
                tree.feature[low + k], b = divmod(int(best[k]), BINS)
                tree.cut[low + k] = edges[tree.feature[low + k]][b]
            f = tree.feature[at]
            moves = (at >= low) & (f >= 0)
            step = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > tree.cut[at])
            at = np.where(moves, step, at)
        forest.trees.append(tree)
        margin += rate * tree.predict(x)
    return forest
