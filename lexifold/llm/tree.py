"""A small classification tree: binary splits on numeric features, chosen by Gini impurity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def _impurity(labels: Sequence[str]) -> float:
    n = len(labels)
    return 1.0 - sum((k / n) ** 2 for k in Counter(labels).values())


def fit(rows: Sequence[Sequence[float]], labels: Sequence[str], depth: int = 8):
    """A tree as nested tuples (feature, threshold, left, right); a leaf is its label.  Ties go to the earlier feature."""
    if depth == 0 or len(set(labels)) == 1:
        return max(sorted(set(labels)), key=Counter(labels).__getitem__)
    best = None
    for feature in range(len(rows[0])):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            left = [y for r, y in zip(rows, labels) if r[feature] <= at]
            right = [y for r, y in zip(rows, labels) if r[feature] > at]
            cost = len(left) * _impurity(left) + len(right) * _impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = cost, feature, at
    if best is None:
        return max(sorted(set(labels)), key=Counter(labels).__getitem__)
    _, feature, at = best
    side = [r[feature] <= at for r in rows]
    parts = [([r for r, s in zip(rows, side) if s == want], [y for y, s in zip(labels, side) if s == want]) for want in (True, False)]
    return feature, at, fit(*parts[0], depth - 1), fit(*parts[1], depth - 1)


def classify(tree, row: Sequence[float]) -> str:
    while not isinstance(tree, str):
        feature, at, left, right = tree
        tree = left if row[feature] <= at else right
    return tree
