"""A small binary decision tree (Gini impurity), for labelled tables that fit in memory many times over."""

import numpy as np


def _gini(positive: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = positive / np.maximum(n, 1)
    return 2 * share * (1 - share) * n


def train(features: np.ndarray, labels: np.ndarray, depth: int = 6, leaf: int = 2):
    """Nested (feature, limit, tree at most limit, tree above) with True or False at the leaves."""
    majority = bool(2 * labels.sum() >= len(labels))
    if depth == 0 or len(labels) < 2 * leaf or labels.all() or not labels.any():
        return majority
    best = (_gini(labels.sum(), np.array(len(labels))) - 1e-9, -1, 0.0)
    for f in range(features.shape[1]):
        order = np.argsort(features[:, f], kind="stable")
        x, y = features[order, f], labels[order]
        n = np.arange(1, len(y))
        left = np.cumsum(y)[:-1]
        cost = _gini(left, n) + _gini(y.sum() - left, len(y) - n)
        cost[(x[1:] == x[:-1]) | (n < leaf) | (len(y) - n < leaf)] = np.inf
        at = int(np.argmin(cost))
        if cost[at] < best[0]:
            best = (cost[at], f, (x[at] + x[at + 1]) / 2)
    _, f, limit = best
    if f < 0:
        return majority
    low = features[:, f] <= limit
    return (f, limit, train(features[low], labels[low], depth - 1, leaf), train(features[~low], labels[~low], depth - 1, leaf))


def decide(tree, row) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree
