"""Small boosted trees on a bounded sample in memory: histogram splits, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 in a leaf. A row goes left if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            goes = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(goes, self.left[at], self.right[at])

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Conjunctions (feature, at most?, threshold) from the root to every node below it."""
        found = []

        def walk(node: int, path: tuple) -> None:
            if path:
                found.append(path)
            if self.feature[node] >= 0:
                f, t = int(self.feature[node]), float(self.threshold[node])
                walk(int(self.left[node]), (*path, (f, True, t)))
                walk(int(self.right[node]), (*path, (f, False, t)))

        walk(0, ())
        return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, at most ``BINS`` - 1 of them."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS)))
    return (values[1:] + values[:-1]) / 2


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.2, smooth: float = 1.0, least: float = 3.0) -> tuple[float, list[Tree]]:
    """(start, trees) of a logistic boosting: the sum of start and tree values is the log odds."""
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    trees = []
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree = _grow(binned, cuts, g, h, depth, rate, smooth, least)
        trees.append(tree)
        score += tree.predict(x)
    return start, trees


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, smooth: float, least: float) -> Tree:
    feature, threshold, left, right, value = [], [], [], [], []

    def add(rows: np.ndarray, level: int) -> int:
        node = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        feature.append(-1), threshold.append(0.0), left.append(0), right.append(0)
        value.append(-rate * gs / (hs + smooth))
        if level == depth or hs < 2 * least:
            return node
        best = (1e-6, -1, 0)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gb = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
            hb = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
            gain = gb**2 / (hb + smooth) + (gs - gb) ** 2 / (hs - hb + smooth) - gs**2 / (hs + smooth)
            gain[(hb < least) | (hs - hb < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            return node
        _, f, k = best
        goes = binned[rows, f] <= k
        feature[node], threshold[node] = f, float(cuts[f][k])
        left[node] = add(rows[goes], level + 1)
        right[node] = add(rows[~goes], level + 1)
        return node

    add(np.arange(len(g)), 0)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, ascending values) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest score, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            v_, n_, _, high = blocks.pop()
            blocks[-1][0] += v_
            blocks[-1][1] += n_
            blocks[-1][3] = high
    xs, ys = [], []
    for total, n, low, high in blocks:
        xs += [low, high] if high > low else [low]
        ys += [total / n] * (2 if high > low else 1)
    return np.array(xs), np.array(ys)


def lasso(rules: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with an L1 penalty (accelerated proximal gradient)."""
    n, m = rules.shape
    x = np.concatenate((rules, np.ones((n, 1))), axis=1)
    probe = np.ones(m + 1)  # power iteration for the largest curvature
    for _ in range(20):
        probe = x.T @ (x @ probe) / n
        probe /= max(np.linalg.norm(probe), 1e-12)
    step = 1.0 / max(np.linalg.norm(x.T @ (x @ probe) / n) / 4, 1e-9)
    w = np.zeros(m + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        gradient = x.T @ (sigmoid(x @ ahead) - y) / n
        fresh = ahead - step * gradient
        fresh[:-1] = np.sign(fresh[:-1]) * np.maximum(np.abs(fresh[:-1]) - step * penalty, 0)
        more = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = fresh + (momentum - 1) / more * (fresh - w)
        w, momentum = fresh, more
    return float(w[-1]), w[:-1]
