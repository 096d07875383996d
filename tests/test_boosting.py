"""Boosted trees grown together are those of Spark ML, and all models that share their rows are grown at once."""

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from dayprint.operators import boosting, training
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoded(spark):
    draw = np.random.default_rng(3)
    a, b, c = draw.normal(size=600), draw.integers(0, 40, 600) / 7, draw.integers(0, 3, 600)
    y = np.sin(2 * a) + b * (c == 1) + draw.normal(size=600) / 5
    rows = [(i, float(p), float(q), float(k), float(v), i % 4) for i, (p, q, k, v) in enumerate(zip(a, b, c, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fold int")
    df = OneHotEncoder(inputCols=["c"], outputCols=["kinds"], dropLast=False).fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "kinds"], outputCol="features").transform(df).select("id", "fold", "label", "features").repartition(5).persist()


def regression(**settings):
    return training.build_estimator(training.ModelConfig("regression", "xgboost", {"n_estimators": 12, "max_depth": 4, **settings}))


def classes():
    return training.build_estimator(training.ModelConfig("classification", "lightgbm", {"n_estimators": 8, "num_leaves": 8}))


def predictions(model, rows, column="prediction"):
    p = F.col(column) if column == "prediction" else vector_to_array(column)
    return np.array([r[0] for r in model.transform(rows).orderBy("id").select(p).collect()])


def test_a_regression_is_sparks(encoded, tmp_path):
    found = boosting.fit_boosted(encoded, [regression()])[0]
    wanted = regression().fit(encoded)
    assert np.allclose(predictions(found, encoded), predictions(wanted, encoded), atol=1e-9)
    assert found.treeWeights == wanted.treeWeights and found.numFeatures == wanted.numFeatures
    assert [t.numNodes for t in found.trees] == [t.numNodes for t in wanted.trees]
    assert np.allclose(found.featureImportances.toArray(), wanted.featureImportances.toArray(), atol=1e-6)
    found.save(str(tmp_path / "kept"))
    assert np.allclose(predictions(GBTRegressionModel.load(str(tmp_path / "kept")), encoded), predictions(wanted, encoded), atol=1e-9)


def test_classes_are_sparks(encoded):
    rows = encoded.withColumn("label", F.when(F.col("label") < 0, 0.0).when(F.col("label") < 1.5, 1.0).otherwise(2.0)).persist()
    found, wanted = boosting.fit_boosted(rows, [classes()])[0], classes().fit(rows)
    assert np.allclose(predictions(found, rows, "rawPrediction"), predictions(wanted, rows, "rawPrediction"), atol=1e-9)
    assert (predictions(found, rows) == predictions(wanted, rows)).all()


def test_models_together_are_those_alone(encoded):
    some, out = [regression(), regression(n_estimators=3, max_depth=2), regression()], [None, None, 2]
    found = boosting.fit_boosted(encoded, some, out)
    for model, estimator, fold in zip(found, some, out):
        rows = encoded if fold is None else encoded.where(F.col("fold") != fold)
        assert np.allclose(predictions(model, encoded), predictions(estimator.fit(rows), encoded), atol=1e-9)


def test_rows_without_differences_make_one_leaf(spark, encoded):
    alike = encoded.withColumn("label", F.lit(0.1))
    model = boosting.fit_boosted(alike, [regression(n_estimators=2)])[0]
    assert [t.numNodes for t in model.trees] == [1, 1]
    assert np.allclose(predictions(model, alike), 0.1)


def test_slots_without_differences_give_the_mean(encoded):
    alike = VectorAssembler(inputCols=["one"], outputCol="features").transform(encoded.drop("features").withColumn("one", F.lit(1.0)))
    model = boosting.fit_boosted(alike, [regression(n_estimators=2)])[0]
    assert np.allclose(predictions(model, alike), encoded.agg(F.avg("label")).first()[0])


def test_labels_are_demanded_of_regressions(encoded):
    with pytest.raises(ValueError, match="Labels"):
        boosting.fit_boosted(encoded.withColumn("label", F.when(F.col("id") != 7, F.col("label"))), [regression()])
    with pytest.raises(ValueError, match="No rows"):
        boosting.fit_boosted(encoded.where("id < 0"), [regression()])


def test_many_values_are_thinned_by_rank():
    values, counts = boosting._thinned(np.arange(100_000.0), np.ones(100_000))
    assert len(values) == boosting.KEPT_VALUES and counts.sum() == 100_000
    found = boosting.thresholds(values, counts, 32)
    assert len(found) == 31 and np.abs(found - np.arange(1, 32) * 100_000 / 32).max() < 100


def test_train_all_grows_the_boosted_models_of_a_task_at_once(spark, monkeypatch):
    found = []
    whole = boosting.fit_boosted

    def seen(rows, estimators, *others):
        found.append(len(estimators))
        return whole(rows, estimators, *others)

    monkeypatch.setattr(training, "fit_boosted", seen)
    models = training.train_all(train_rows(spark, FOLDER), hyperparameters={"n_estimators": 2, "max_depth": 2})
    assert sorted(found) == [3, 3]
    assert list(models) == [f"{t}_{a}" for t in ("regression", "classification") for a in training.TRAIN_ALL]


def test_folds_grow_beside_the_model_of_all_rows(spark, monkeypatch):
    found = []
    whole = boosting.fit_boosted

    def seen(rows, estimators, *others):
        found.append(len(estimators))
        return whole(rows, estimators, *others)

    monkeypatch.setattr(training, "fit_boosted", seen)
    config = training.ModelConfig("regression", "xgboost", {"n_estimators": 2, "max_depth": 2}, feature_engineering=False)
    rows = train_rows(spark, FOLDER)
    metrics = training.train(config, rows, key="record_id").metrics
    assert found == [6] and len(metrics["cv_scores"]) == 5 and "train_r2" in metrics
