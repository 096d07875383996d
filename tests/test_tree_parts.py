"""Shapley values from the tables of the trees' lowest parts are those of the walk."""

import numpy as np
import pytest

from dayprint.operators import tree_tables
from dayprint.operators.tree_tables import TreeEnsemble

SLOTS = 5


def grown(trees: int, depth: int, outputs: int, seed: int) -> TreeEnsemble:
    """Random trees with leaves at all depths and features that recur on a path."""
    rng = np.random.default_rng(seed)
    nodes, roots = [], []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or (level > 1 and rng.random() < 0.2):
            nodes[at] = (-1, np.nan, at, at, cover, rng.normal(size=outputs))
        else:
            share = rng.uniform(0.05, 0.95)
            left, right = grow(level + 1, cover * share), grow(level + 1, cover * (1 - share))
            nodes[at] = (int(rng.integers(SLOTS)), rng.normal(), left, right, cover, np.zeros(outputs))
        return at

    for _ in range(trees):
        roots.append(grow(0, 1000.0))
    feature, threshold, left, right, cover, value = map(np.array, zip(*nodes))
    return TreeEnsemble(np.array(roots), feature, threshold, left, right, cover, value, depth, np.zeros(outputs))


@pytest.mark.parametrize("depth,outputs", [(0, 1), (1, 1), (2, 3), (5, 1), (6, 3)])
def test_values_are_looked_up(monkeypatch, depth, outputs):
    e = grown(6, depth, outputs, seed=depth)
    x = np.random.default_rng(1).normal(size=(tree_tables.ROWS_AT_ONCE + 50, SLOTS))
    walked = e.shapley(x)
    e.tabulate(SLOTS)
    monkeypatch.setattr(TreeEnsemble, "_walk", None)
    found = e.shapley(x)
    assert np.allclose(found, walked, atol=1e-10)
    assert np.allclose(found.sum(1) + e.expected(), e.predict(x))
    assert e.shapley(x[:0]).shape == (0, SLOTS, outputs)


def test_large_trees_are_walked(monkeypatch):
    e = grown(3, 6, 1, seed=9)
    x = np.random.default_rng(2).normal(size=(20, SLOTS))
    walked = e.shapley(x)
    monkeypatch.setattr(tree_tables, "MOST_TABLE", 1000)
    assert e.tabulate(SLOTS).parts is None
    assert (e.shapley(x) == walked).all()
