"""Gradient-boosted trees over a bounded table of weighted cells, and their score as a column."""

import math

import numpy as np
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE = 30, 3, 0.3
SHRINK = 1.0  # added to the second derivatives


def _leaf(gradient, curve):
    return RATE * gradient / (curve + SHRINK)


def _grow(x, gradient, curve, rows, depth):
    """A tree as nested (feature, limit, left, right); a leaf is a number. Left is <= limit."""
    g, h = gradient[rows].sum(), curve[rows].sum()
    best, gain = None, 1e-6
    for feature in range(x.shape[1] if depth else 0):
        values = x[rows, feature]
        size = int(values.max()) + 1 if len(rows) else 0
        left_g, left_h = np.cumsum(np.bincount(values, gradient[rows], size)), np.cumsum(np.bincount(values, curve[rows], size))
        for limit in range(size - 1):
            a, b = left_g[limit], left_h[limit]
            value = a * a / (b + SHRINK) + (g - a) ** 2 / (h - b + SHRINK) - g * g / (h + SHRINK)
            if value > gain:
                best, gain = (feature, limit), value
    if best is None:
        return _leaf(g, h)
    feature, limit = best
    left = x[rows, feature] <= limit
    return feature, limit, _grow(x, gradient, curve, rows[left], depth - 1), _grow(x, gradient, curve, rows[~left], depth - 1)


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, limit, left, right = tree
    return np.where(x[:, feature] <= limit, _apply(left, x), _apply(right, x))


def fit(x, positive, total):
    """(base score, trees) for cells of small whole-numbered features with counts of positive and of all cases."""
    n, p = float(total.sum()), float(positive.sum())
    base = math.log((p + 0.5) / (n - p + 0.5))
    score, trees = np.full(len(x), base), []
    for _ in range(ROUNDS if len(x) else 0):
        chance = 1 / (1 + np.exp(-score))
        tree = _grow(x, positive - total * chance, total * chance * (1 - chance), np.arange(len(x)), DEPTH)
        trees.append(tree)
        score = score + _apply(tree, x)
    return base, trees


def predict(model, x):
    base, trees = model
    return base + sum((_apply(tree, x) for tree in trees), np.zeros(len(x)))


def _column(tree, features):
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, limit, left, right = tree
    return F.when(features[feature] <= limit, _column(left, features)).otherwise(_column(right, features))


def score_column(model, features):
    """The model's score (log odds) of the feature columns."""
    base, trees = model
    return sum((_column(tree, features) for tree in trees), F.lit(float(base)))
