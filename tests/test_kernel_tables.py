"""Least-squares Shapley values from tables of split sides are those of the combined rows."""

import numpy as np
import pytest

from dayprint.operators import kernel_shapley
from dayprint.operators.kernel_shapley import KernelExplainer
from dayprint.operators.tree_tables import TreeEnsemble


def ensemble(draw, trees, depth, slots, outputs):
    """Random full trees; a feature may come back on a path."""
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    number = np.arange(nodes)
    parts = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    for t in range(trees):
        base = t * nodes
        parts["feature"].append(np.where(number < inner, draw.integers(0, slots, nodes), -1))
        parts["threshold"].append(draw.normal(size=nodes))
        parts["left"].append(base + np.where(number < inner, 2 * number + 1, 0))
        parts["right"].append(base + np.where(number < inner, 2 * number + 2, 0))
        parts["value"].append(draw.normal(size=(nodes, outputs)))
    joined = {k: np.concatenate(v) for k, v in parts.items()}
    return TreeEnsemble(roots=np.arange(trees) * nodes, depth=depth, intercept=draw.normal(size=outputs), cover=np.ones(trees * nodes), **joined)


def explainer(model, draw, slots, budget):
    return KernelExplainer.of(model, [(list(draw.normal(size=slots)), int(n)) for n in draw.integers(1, 9, 5)], budget)


@pytest.mark.parametrize("trees, depth, slots, outputs, budget", [(4, 3, 9, 1, 120), (3, 2, 6, 3, 40), (2, 3, 4, 1, 512)])
def test_tables_give_the_values_of_the_combined_rows(trees, depth, slots, outputs, budget):
    draw = np.random.default_rng(trees)
    model = ensemble(draw, trees, depth, slots, outputs)
    plain = explainer(model, draw, slots, budget)
    quick = KernelExplainer(plain.model, plain.centres, plain.shares, plain.plans).tabulate()
    assert plain.tables is None and len(quick.tables) == trees
    x = draw.normal(size=(300, slots))
    for found, wanted in zip(quick.explain(x), plain.explain(x)):
        assert np.allclose(found, wanted, atol=1e-10)
    for found in quick.explain(x[:0]):
        assert found.shape == (0, slots, outputs)


def test_a_record_of_shallow_trees_needs_no_combined_rows(monkeypatch):
    draw = np.random.default_rng(1)
    model = ensemble(draw, 5, 3, 8, 1)
    quick = explainer(model, draw, 8, 200).tabulate()
    monkeypatch.setattr(KernelExplainer, "coalition_values", None)
    assert quick.explain(draw.normal(size=(10_000, 8)))[0].shape == (10_000, 8, 1)


def test_deep_trees_are_predicted_on_combined_rows(monkeypatch):
    draw = np.random.default_rng(2)
    deep = explainer(ensemble(draw, 1, 4, 6, 1), draw, 6, 40)
    assert deep.tabulate().tables is None
    monkeypatch.setattr(kernel_shapley, "MOST_TABLE", 1000)
    assert explainer(ensemble(draw, 4, 3, 9, 1), draw, 9, 120).tabulate().tables is None
