"""A table that arrives in one task is fitted, scored and explained by all cores."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from dayprint.operators import attribution, training
from dayprint.operators.kernel_shapley import outputs_of
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"
SMALL = {"n_estimators": 8, "max_depth": 4}


@pytest.fixture(scope="module")
def train(spark):
    return train_rows(spark, FOLDER).coalesce(1).limit(300).cache()


@pytest.fixture(scope="module")
def fitted(train):
    config = training.ModelConfig("regression", "random_forest", SMALL, feature_engineering=False)
    return training.train(config, train)


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


class Seen(Exception):
    pass


@pytest.mark.parametrize("all_models", [False, True])
def test_a_fit_gets_its_rows_on_all_cores(spark, train, monkeypatch, all_models):
    found = []

    class Estimator:
        def fit(self, rows):
            found.append((tasks_with_rows(rows), rows.count()))
            raise Seen

    monkeypatch.setattr(training, "build_estimator", lambda config: Estimator())
    with pytest.raises(Seen):
        if all_models:
            training.train_all(train, ("random_forest",), ("regression",))
        else:
            training.train(training.ModelConfig("regression", "random_forest", feature_engineering=False), train)
    assert found == [(spark.sparkContext.defaultParallelism, train.count())]


def test_scores_and_explanations_use_all_cores(spark, train, fitted):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_with_rows(train) == 1
    scored = fitted.predict(train)
    assert tasks_with_rows(scored) >= cores
    assert scored.count() == train.count()
    assert tasks_with_rows(attribution.explain_sample(spark, train, fitted)) >= cores
    encoded = fitted.encode(train)
    centre = [([0.0] * encoded.first()["features"].size, 1)]
    assert tasks_with_rows(attribution.kernel_attribution(encoded, fitted, centre, budget=60)) >= cores


def test_sampled_values_are_those_of_the_spark_model(spark, train, fitted):
    encoded = fitted.encode(train).limit(3).cache()
    slots = encoded.first()["features"].size
    # Centres lie between the categories' 0 and 1.
    centres = [([0.06 * i for i in range(slots)], 2), ([0.9 - 0.05 * i for i in range(slots)], 1)]
    inside = outputs_of(spark, fitted.model)
    for c, _ in centres:
        assert inside.predict(np.array([c]))[0, 0] == pytest.approx(fitted.model.predict(Vectors.dense(c)))
    order, rng, want = list(range(slots)), random.Random(42), {}
    rng.shuffle(order)
    for r in encoded.collect():
        for c, n in centres:
            z = list(c)
            last = fitted.model.predict(Vectors.dense(z))
            for s in order:
                z[s] = r["features"][s]
                now = fitted.model.predict(Vectors.dense(z))
                want[r["record_id"], s] = want.get((r["record_id"], s), 0) + (now - last) * n / 3
                last = now
    parts = attribution.sampled_attribution(encoded, "record_id", fitted, centres, 1)
    assert {(r["record_id"], r["slot"]): r["attribution"] for r in parts.collect()} == pytest.approx(want, abs=1e-9)
    assert tasks_with_rows(attribution.sampled_attribution(fitted.encode(train), "record_id", fitted, centres, 1)) >= spark.sparkContext.defaultParallelism
