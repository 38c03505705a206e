"""Fitted forests as tables, read at several depths.

The library grows a forest level by level: while all nodes of a level fit its memory, a forest of
less depth is the upper part of a deeper one with equal other parameters (same draws, same splits).  So the
votes at every depth of a grid come from the deepest forest: a node at that depth is a leaf, and leaves of a parent
with one prediction are merged into it, as the library does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray          # -1: a leaf
    threshold: np.ndarray
    categories: np.ndarray       # those that go left, a row a node
    categorical: np.ndarray
    left: np.ndarray
    right: np.ndarray
    votes: np.ndarray            # shares of the classes, a row a node
    ends: dict                   # depth -> the node at which a path to a node ends

    @classmethod
    def of(cls, nodes: Sequence, depths: Sequence[int]) -> Tree:
        """``nodes``: rows of the saved model in the order of their ids, a parent before its children."""
        n = len(nodes)
        left, right = (np.array([x[c] for x in nodes]) for c in ("leftChild", "rightChild"))
        feature = np.array([x["split"]["featureIndex"] for x in nodes])
        categorical = np.array([x["split"]["numCategories"] >= 0 for x in nodes])
        values = [x["split"]["leftCategoriesOrThreshold"] for x in nodes]
        arity = max([x["split"]["numCategories"] for x in nodes] + [1])
        categories = np.zeros((n, arity), dtype=bool)
        for i in np.flatnonzero(categorical):
            categories[i, np.asarray(values[i], dtype=np.int64)] = True
        threshold = np.array([0.0 if c or not v else v[0] for c, v in zip(categorical, values, strict=True)])
        counts = np.array([x["impurityStats"] for x in nodes], dtype=np.float64)
        total = counts.sum(axis=1, keepdims=True)
        votes = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)
        best = [x["prediction"] for x in nodes]
        level = np.zeros(n, dtype=np.int64)
        for i in range(n):
            if left[i] >= 0:
                level[left[i]] = level[right[i]] = level[i] + 1
        ends = {}
        for depth in depths:
            leaf = (left < 0) | (level >= depth)
            for i in range(n - 1, -1, -1):
                a, b = left[i], right[i]
                if not leaf[i] and leaf[a] and leaf[b] and best[a] == best[b]:
                    leaf[i] = True
            end = np.full(n, -1)
            end[0] = 0 if leaf[0] else -1
            for i in range(n):
                if left[i] >= 0:
                    for c in (left[i], right[i]):
                        end[c] = end[i] if end[i] >= 0 else c if leaf[c] else -1
            ends[depth] = end
        return cls(feature, threshold, categories, categorical, left, right, votes, ends)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            node = at[rows]
            value = x[rows, self.feature[node]]
            goes = value <= self.threshold[node]
            if (own := self.categorical[node]).any():
                goes[own] = self.categories[node[own], value[own].astype(np.int64)]
            at[rows] = np.where(goes, self.left[node], self.right[node])
        return at


def forest(nodes: Sequence, depths: Sequence[int]) -> list[Tree]:
    """``nodes``: ``(treeID, nodeData)`` of a saved forest."""
    trees: dict = {}
    for tree, node in sorted(((r["treeID"], r["nodeData"]) for r in nodes), key=lambda r: (r[0], r[1]["id"])):
        trees.setdefault(tree, []).append(node)
    return [Tree.of(rows, depths) for _, rows in sorted(trees.items())]


def predictions(trees: Sequence[Tree], x: np.ndarray) -> dict[int, np.ndarray]:
    """Depth -> the class with most votes (ties: the first), votes added in the trees' order."""
    votes: dict = {}
    for tree in trees:
        at = tree.leaves(x)
        for depth, end in tree.ends.items():
            votes[depth] = votes.get(depth, 0.0) + tree.votes[end[at]]
    return {depth: v.argmax(axis=1) for depth, v in votes.items()}


def weighted_f1(counts: dict) -> float:
    """The library's default metric from ``(label, prediction) -> rows``."""
    labels = sorted({label for label, _ in counts})
    total, out = sum(counts.values()), 0.0
    for c in labels:
        own = sum(n for (label, _), n in counts.items() if label == c)
        called = sum(n for (_, pred), n in counts.items() if pred == c)
        right = counts.get((c, c), 0)
        p, r = right / called if called else 0.0, right / own
        out += (2.0 * p * r / (p + r) if p + r else 0.0) * own / total
    return out
