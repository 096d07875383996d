"""Kernel machines, probabilities from margins, folds of linear models."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayprint.constants import FOOTPRINT, LEVEL
from dayprint.operators import training
from dayprint.operators.calibration import platt_scaling, scaled_probabilities
from dayprint.operators.kernel_features import FourierFeatures, fourier_map
from dayprint.operators.model_store import load_model, save_model
from dayprint.plans.catalogue import train_rows
from dayprint.operators.stages import create_preprocessor

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ring(spark):
    """Low inside a ring, Medium on it, High around it: no line parts them."""
    draw = np.random.default_rng(1)
    angle, level = draw.uniform(0, 2 * np.pi, 300), draw.integers(0, 3, 300)
    radius = 0.5 + 1.5 * level + 0.1 * draw.normal(size=300)
    label = ("Low", "Medium", "High")
    rows = [(float(r * np.cos(a)), float(r * np.sin(a)), float(3.0 + 6 * (k == 1)), label[k]) for r, a, k in zip(radius, angle, level)]
    return spark.createDataFrame(rows, f"a double, b double, {FOOTPRINT} double, {LEVEL} string").coalesce(1).cache()


def accuracy(out):
    return out.agg(F.avg((F.col(LEVEL) == F.col(f"{LEVEL}_predicted")).cast("double"))).first()[0]


def test_ring(ring):
    encoder = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")]).fit(ring)
    found = {}
    for kernel in ("linear", "rbf"):
        config = training.ModelConfig("classification", "svc", {"kernel": kernel, "gamma": 1.0, "components": 48, "max_iter": 12, "probability": False})
        found[kernel] = accuracy(training.train(config, ring, preprocessor=encoder).predict(ring))
    assert found["linear"] < 0.75 and found["rbf"] > 0.9
    off = {}
    for kernel in ("linear", "rbf"):
        model = training.train(training.ModelConfig("regression", "svr", {"kernel": kernel, "gamma": 1.0, "components": 64}), ring, preprocessor=encoder)
        off[kernel] = model.metrics["train_rmse"]
    assert off["rbf"] < 0.3 * off["linear"]


def test_map_approaches_the_kernel(spark, ring):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(50, 6))
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    wide, narrow = (fourier_map(x, n, 0.3, 1) for n in (4000, 100))
    assert np.abs(wide @ wide.T - want).max() < 0.1 and np.abs(narrow @ narrow.T - want).mean() < 0.12
    encoded = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ring)
    model = FourierFeatures(components=10).fit(encoded)
    values = np.array([[r["a"], r["b"]] for r in encoded.collect()])
    assert model.getOrDefault("gamma") == pytest.approx(1 / (2 * values.var()))
    got = [r["k"] for r in model.transform(encoded).select(vector_to_array("kernel_features").alias("k")).collect()]
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, fourier_map(values, 10, model.getOrDefault("gamma"), 42))))
    assert model.transform(encoded.limit(0)).count() == 0


def test_unknown_kernel():
    with pytest.raises(ValueError, match="Unknown kernel"):
        training.build_estimator(training.ModelConfig("regression", "svr", {"kernel": "poly"}))


def test_saved_with_curves(spark, ring, tmp_path):
    encoder = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")]).fit(ring)
    config = training.ModelConfig("classification", "svc", {"gamma": 1.0, "components": 24, "max_iter": 5})
    model = training.train(config, ring, preprocessor=encoder)
    again = load_model(spark, save_model(spark, model, str(tmp_path)))
    rows = lambda m: sorted(tuple(r["class_probabilities"]) for r in m.predict(ring).collect())
    assert again.calibration == model.calibration and rows(again) == rows(model)
    p = np.array(rows(model))
    assert np.allclose(p.sum(1), 1) and p.min() >= 0
    config = training.ModelConfig("classification", "svc", {"probability": False, "kernel": "linear"})
    bare = training.train(config, ring, preprocessor=encoder)
    assert bare.calibration is None and bare.predict(ring).where("class_probabilities is not null").count() == 0


def test_curves(spark):
    """Margins drawn from known curves give these back."""
    draw = np.random.default_rng(5)
    m = draw.normal(size=(4000, 2)) * 2
    label = (draw.random(4000) < 1 / (1 + np.exp(-(1.5 * m[:, 1] - 0.5)))).astype(float)
    rows = spark.createDataFrame([(float(y), [float(a) for a in r]) for y, r in zip(label, m)], "label double, margins array<double>")
    (a0, _), (a1, b1) = platt_scaling(rows, 2)
    assert abs(a0) < 0.1 and abs(a1 - 1.5) < 0.2 and abs(b1 + 0.5) < 0.2
    same = platt_scaling(rows.withColumn("label", F.lit(0.0)), 2)
    assert same[0][0] == same[1][0] == 0 and same[0][1] > 5 and same[1][1] < -5
    far = rows.limit(1).select(scaled_probabilities(F.array(F.lit(-1e6), F.lit(-1e6)), [[1.0, 0.0], [1.0, 0.0]]).alias("p")).first()["p"]
    assert far == [0.5, 0.5]


def test_folds_equal_fits(spark):
    """Scores from products equal those of Spark's own fits, with one-hot slots that depend on each other."""
    rows = train_rows(spark, FOLDER).withColumn("fold", F.pmod(F.xxhash64("record_id"), F.lit(3)).cast("int"))
    encoder = create_preprocessor(["distance_km", "electricity_kwh"], ["food_type", "day_type"], scale=False).fit(rows)
    encoded = training.with_label(encoder.transform(rows), "regression").select(FOOTPRINT, LEVEL, "features", "label", "fold").cache()
    config = training.ModelConfig("regression", "linear_regression", cv_folds=3)
    found = training.cross_validate(config, encoder, encoded)
    for i, score in enumerate(found["cv_scores"]):
        model = training.build_estimator(config).fit(encoded.where(F.col("fold") != i))
        out = training.TrainedModel(config, encoder, model).apply(encoded.where(F.col("fold") == i))
        assert score == pytest.approx(training._score(config, out)["r2"], abs=1e-6)
    assert found["cv_mean"] == pytest.approx(np.mean(found["cv_scores"]))
