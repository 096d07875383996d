"""Shapley values of tree ensembles and of any model, against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from dayprint.constants import FOOTPRINT
from dayprint.operators import attribution, training
from dayprint.operators.kernel_shapley import KernelExplainer, coalitions, outputs_of
from dayprint.operators.tree_tables import tree_ensemble
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"


def subsets_values(value, features):
    """Shapley values from the values of all subsets of features."""
    out = np.zeros(features)
    for i in range(features):
        others = [j for j in range(features) if j != i]
        for size in range(features):
            weight = math.factorial(size) * math.factorial(features - 1 - size) / math.factorial(features)
            for s in itertools.combinations(others, size):
                out[i] += weight * (value(frozenset(s) | {i}) - value(frozenset(s)))
    return out


def path_value(e, x, known, output):
    """The ensemble's output when unknown splits send the record both ways by the rows seen."""

    def below(node):
        if e.feature[node] < 0:
            return e.value[node][output]
        left, right = e.left[node], e.right[node]
        if e.feature[node] in known:
            return below(left if x[e.feature[node]] <= e.threshold[node] else right)
        return (e.cover[left] * below(left) + e.cover[right] * below(right)) / e.cover[node]

    return sum(below(r) for r in e.roots)


@pytest.fixture(scope="module")
def train(spark):
    return train_rows(spark, FOLDER)


FOUR = ["distance_km", "electricity_kwh", "waste_generated_kg", "eco_actions"]


def fitted(train, task, algorithm, parameters, numeric=FOUR, categorical=()):
    from dayprint.operators.stages import create_preprocessor

    encoder = create_preprocessor(list(numeric), list(categorical), scale=False).fit(train)
    return training.train(training.ModelConfig(task, algorithm, parameters), train, preprocessor=encoder)


@pytest.mark.parametrize(
    "task, algorithm, parameters",
    [
        ("regression", "random_forest", {"n_estimators": 4, "max_depth": 6}),
        ("regression", "xgboost", {"n_estimators": 4, "max_depth": 4}),
        ("classification", "random_forest", {"n_estimators": 3, "max_depth": 5}),
        ("classification", "xgboost", {"n_estimators": 2, "max_depth": 3}),
    ],
)
def test_tree_values_equal_all_subsets(spark, train, task, algorithm, parameters):
    model = fitted(train, task, algorithm, parameters)
    e = tree_ensemble(spark, model.model)
    rows = model.encode(train).orderBy("record_id").limit(12).select(vector_to_array("features").alias("x")).collect()
    x = np.array([r["x"] for r in rows])
    found = e.shapley(x)
    for r in range(len(x)):
        for k in range(e.outputs):
            want = subsets_values(lambda s: path_value(e, x[r], s, k), 4)
            assert np.allclose(found[r, :, k], want, atol=1e-9)
    assert np.allclose(found.sum(1) + e.expected(), e.predict(x), atol=1e-9)


def test_tables_predict_as_the_model(spark, train):
    model = fitted(train, "regression", "random_forest", {"n_estimators": 5, "max_depth": 5}, FOUR, ["food_type", "transport_mode"])
    e = tree_ensemble(spark, model.model)
    rows = model.apply(model.encode(train)).select(vector_to_array("features").alias("x"), f"{FOOTPRINT}_predicted").collect()
    assert np.allclose(e.predict(np.array([r[0] for r in rows]))[:, 0], [r[1] for r in rows])


def test_single_leaf(spark, train):
    model = fitted(train, "regression", "random_forest", {"n_estimators": 2, "max_depth": 0})
    e = tree_ensemble(spark, model.model)
    x = np.ones((3, 4))
    assert (e.shapley(x) == 0).all() and np.allclose(e.predict(x), e.expected())
    assert e.shapley(np.zeros((0, 4))).shape == (0, 4, 1)


def test_records_differ(spark, train):
    model = fitted(train, "classification", "xgboost", {"n_estimators": 3, "max_depth": 3})
    out = attribution.explain_sample(spark, train, model).select("shap_values", "explained_output", "expected_output").collect()
    assert len({tuple(r[0].values()) for r in out}) > 20
    for r in out:
        assert abs(sum(r[0].values()) + r[2] - r[1]) < 1e-9


class Curved:
    """Products and steps: far from linear."""

    def predict(self, x):
        return np.stack([x[:, 0] * x[:, 1] + np.maximum(x[:, 2:].sum(1), 0), np.sin(x).prod(1)], 1)


def centred(explainer, x, known, output):
    mixed = np.where([i in known for i in range(len(x))], x, explainer.centres)
    return explainer.shares @ explainer.model.predict(mixed)[:, output]


def test_kernel_lists_all_coalitions():
    draw = np.random.default_rng(2)
    explainer = KernelExplainer.of(Curved(), [(list(draw.normal(size=5)), n) for n in (3, 1)], budget=100)
    assert len(explainer.plans) == 1
    x = draw.normal(size=(4, 5))
    values, errors = explainer.explain(x)
    assert (errors == 0).all()
    for r in range(4):
        for k in range(2):
            assert np.allclose(values[r, :, k], subsets_values(lambda s: centred(explainer, x[r], s, k), 5), atol=1e-8)


def test_kernel_is_within_its_error():
    draw = np.random.default_rng(3)
    centres = [(list(draw.normal(size=10)), 1), (list(draw.normal(size=10)), 2)]
    x = draw.normal(size=(30, 10))
    exact, none = KernelExplainer.of(Curved(), centres, budget=2000).explain(x)
    assert (none == 0).all()
    values, errors = KernelExplainer.of(Curved(), centres, budget=300, batches=8).explain(x)
    off = np.abs(values - exact)
    assert (off <= 4 * errors + 1e-9).mean() > 0.97 and off.max() > 0
    total = values.sum(1) + KernelExplainer.of(Curved(), centres).base
    assert np.allclose(total, Curved().predict(x), atol=1e-8)


def test_coalitions():
    whole = coalitions(4, 14, 3, 1)
    assert len(whole) == 1 and len(whole[0][0]) == 14
    some = coalitions(8, 40, 3, 1)
    assert len(some) == 3 and all(len(z) == len(w) for z, w in some)
    assert all(np.isclose(w.sum(), some[0][1].sum()) for _, w in some)
    assert all((z.any(1) & ~z.all(1)).all() for z, _ in some)


def test_kernel_of_spark_models(spark, train):
    for task, algorithm, parameters in (("regression", "linear_regression", {}), ("classification", "logistic_regression", {}), ("regression", "xgboost", {"n_estimators": 3, "max_depth": 3})):
        model = fitted(train, task, algorithm, parameters)
        encoded = model.encode(train)
        centres = attribution.kmeans_background(encoded, k=2)
        rows = model.apply(attribution.kernel_attribution(encoded, model, centres)).limit(20).collect()
        for r in rows:
            total = np.array(r["shap_values"]).sum(1) + np.array(r["base_values"])
            want = [r[f"{FOOTPRINT}_predicted"]] if task == "regression" else r["class_probabilities"]
            assert np.allclose(total, want, atol=1e-6)
        assert outputs_of(spark, model.model).predict(np.array(centres[0][0])[None]).shape[0] == 1
