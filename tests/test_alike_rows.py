"""A forest is fitted on and scores rows in an order in which alike rows follow each other."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayprint.constants import FOOTPRINT
from dayprint.operators import training
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"
SMALL = {"n_estimators": 3, "max_depth": 3}


class Seen(Exception):
    pass


def ordered(df) -> bool:
    """Whether every task has its rows by the sides of the means, then by cells."""
    rows = df.select(F.spark_partition_id().alias("task"), vector_to_array("features").alias("x")).collect()
    found = {}
    for r in rows:
        x = np.array(r["x"])
        found.setdefault(r["task"], []).append((tuple(x > 0), tuple(np.floor(x))))
    return all(keys == sorted(keys) for keys in found.values())


@pytest.mark.parametrize("algorithm", ["random_forest", "xgboost"])
def test_forests_are_fitted_on_alike_rows_together(spark, monkeypatch, algorithm):
    found = []

    class Estimator:
        def fit(self, rows):
            found.append((ordered(rows), rows.count()))
            raise Seen

    rows = train_rows(spark, FOLDER)
    monkeypatch.setattr(training, "build_estimator", lambda config: Estimator())
    with pytest.raises(Seen):
        training.train(training.ModelConfig("regression", algorithm, feature_engineering=False), rows)
    assert found == [(algorithm == "random_forest", rows.count())]


def test_scores_of_a_forest_do_not_depend_on_the_order(spark):
    rows = train_rows(spark, FOLDER).limit(300).cache()
    fitted = training.train(training.ModelConfig("regression", "random_forest", SMALL, feature_engineering=False), rows)
    seen = fitted.ordered(fitted.encode(fitted.dealt(rows)))
    assert ordered(seen) and not ordered(fitted.encode(fitted.dealt(rows)))
    column = f"{FOOTPRINT}_predicted"
    got = {r["record_id"]: r[column] for r in fitted.predict(rows).collect()}
    want = {r["record_id"]: r[column] for r in fitted.apply(fitted.encode(rows)).collect()}
    assert got == want and len(got) == 300
