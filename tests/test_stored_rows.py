"""Rows are dealt out and written once before an encoder learns from them; scores that nobody reads are left out."""

import threading

import pytest

from dayprint.operators import training
from dayprint.operators.stages import create_preprocessor
from dayprint.plans import catalogue
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"
SMALL = {"n_estimators": 2, "max_depth": 2}


class Seen(Exception):
    pass


class Encoder:
    def __init__(self, found):
        self.found = found

    def fit(self, rows):
        self.found.append((rows.inputFiles(), rows.count()))
        raise Seen


def one_task(spark):
    return train_rows(spark, FOLDER).coalesce(1)


@pytest.mark.parametrize("all_models", [False, True])
def test_an_encoder_learns_from_stored_rows(spark, monkeypatch, all_models):
    found = []
    monkeypatch.setattr(training, "create_preprocessor", lambda **_: Encoder(found))
    rows = one_task(spark)
    with pytest.raises(Seen):
        if all_models:
            training.train_all(rows, ("random_forest",), ("regression",))
        else:
            training.train(training.ModelConfig("regression", "random_forest", SMALL), rows)
    files, n = found[0]
    assert n == rows.count()
    assert len(files) >= spark.sparkContext.defaultParallelism
    assert not any("events.parquet" in f for f in files)


@pytest.mark.parametrize("name", ["ensemble_predict", "robust_regressor", "svc_probabilities", "model_catalog"])
def test_a_query_with_its_own_encoder_stores_its_rows(spark, monkeypatch, name):
    found = []
    monkeypatch.setattr(catalogue.stages, "create_preprocessor", lambda **_: Encoder(found))
    with pytest.raises(Seen):
        catalogue.QUERIES[name](spark, FOLDER)
    assert len(found[0][0]) >= spark.sparkContext.defaultParallelism
    assert not any("events.parquet" in f for f in found[0][0])


def test_training_scores_can_be_left_out(spark, monkeypatch):
    config = training.ModelConfig("regression", "random_forest", SMALL, feature_engineering=False)
    rows = one_task(spark)
    encoder = create_preprocessor().fit(rows)
    with_scores = training.train(config, rows, preprocessor=encoder)
    assert set(with_scores.metrics) == {"train_rmse", "train_r2"}
    without = training.train(config, rows, rows, encoder, measure=False)
    assert set(without.metrics) == {"val_rmse", "val_r2"}
    assert without.model.toDebugString.split("\n")[1:] == with_scores.model.toDebugString.split("\n")[1:]


def test_configurations_of_the_catalogue_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def train(config, *_, **__):
        both.wait()
        metric = "train_r2" if config.model_type == "regression" else "train_accuracy"
        return training.TrainedModel(config, None, None, {metric: 0.5})

    monkeypatch.setattr(training, "train", train)
    rows = catalogue.QUERIES["model_catalog"](spark, FOLDER).collect()
    assert {r["name"] for r in rows} == set(training.default_configs())
    assert all(r["beats_guessing"] for r in rows)


def test_stored_rows_are_read_in_the_order_of_their_files(spark):
    found = {tuple(r["id"] for r in training.stored(spark.range(1000).coalesce(1)).collect()) for _ in range(4)}
    assert len(found) == 1 and sorted(found.pop()) == list(range(1000))
    assert training.stored(spark.range(0)).count() == 0
