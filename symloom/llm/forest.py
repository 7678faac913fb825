"""A random forest in numpy: binned features, Gini splits, trees as arrays."""

from __future__ import annotations

import numpy as np

BINS = 64


class Forest:
    """Binary classification; predict gives the mean share of positives over the trees."""

    def __init__(self, edges: np.ndarray, trees: list[tuple[np.ndarray, ...]]):
        self.edges, self.trees = edges, trees

    @staticmethod
    def fit(
        x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 12, least: int = 2, seed: int = 7
    ) -> Forest:
        """Fit on rows x (n, features) with labels y in {0, 1}; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        n, features = x.shape
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = np.stack([np.quantile(x[:, j], quantiles) for j in range(features)]) if n else np.zeros((features, BINS - 1))
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(features)], 1).astype(np.int16)
        tries = max(2, int(np.ceil(np.sqrt(features))) + 1)
        positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        grown = []
        for _ in range(trees):
            size = max(1, min(len(positive), len(negative)) * 2, len(y) // 2)
            rows = np.concatenate(
                [rng.choice(g, max(1, size // 2)) for g in (positive, negative) if len(g)] or [np.zeros(0, int)]
            )
            grown.append(_grow(binned, y, rows, rng, tries, depth, least))
        return Forest(edges, grown)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = np.stack(
            [np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1
        ).astype(np.int16)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int32)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = binned[rows, np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += value[node]
        return total / max(1, len(self.trees))


def _grow(binned, y, rows, rng, tries, depth, least) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        positives = int(y[rows].sum())
        feature.append(-1)
        cut.append(0)
        left.append(0)
        right.append(0)
        value.append(positives / max(1, len(rows)))
        if level >= depth or len(rows) < 2 * least or positives in (0, len(rows)):
            return at
        best = (1e-9, -1, 0)
        n = len(rows)
        base = positives * (n - positives) / n
        labels = y[rows]
        for j in rng.permutation(binned.shape[1])[:tries]:
            column = binned[rows, j]
            all_ = np.bincount(column, minlength=BINS).cumsum()[:-1]
            pos = np.bincount(column, weights=labels, minlength=BINS).cumsum()[:-1]
            rest, rest_pos = n - all_, positives - pos
            ok = (all_ >= least) & (rest >= least)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = base - pos * (all_ - pos) / all_ - rest_pos * (rest - rest_pos) / rest
            gain[~ok] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(j), k)
        if best[1] < 0:
            return at
        go = binned[rows, best[1]] <= best[2]
        feature[at], cut[at] = best[1], best[2]
        left[at] = node(rows[go], level + 1)
        right[at] = node(rows[~go], level + 1)
        return at

    node(rows, 0)
    return (
        np.array(feature, np.int32),
        np.array(cut, np.int32),
        np.array(left, np.int32),
        np.array(right, np.int32),
        np.array(value),
    )
