"""Models are scored whatever their family, and queries fit what they name in full."""

import pytest
from pyspark.sql import functions as F

from dayprint.constants import LEVELS
from dayprint.operators import training
from dayprint.plans import catalogue
from dayprint.plans.catalogue import train_rows

FOLDER = "/root/testdata/sf0.001"


def test_a_multinomial_model_predicts(spark):
    train = train_rows(spark, FOLDER)
    config = training.ModelConfig("classification", "logistic_regression", {"max_iter": 20}, feature_engineering=False)
    rows = training.train(config, train, measure=False).predict(train)
    total = F.aggregate("class_probabilities", F.lit(0.0), lambda a, p: a + p)
    found = rows.agg(F.count(F.lit(1)), F.max(F.abs(total - 1)), F.count_if(F.size("class_probabilities") == len(LEVELS))).first()
    assert found[0] == found[2] == train.count()
    assert found[1] < 1e-9


def test_the_catalogue_is_cross_validated_with_all_its_trees(spark, monkeypatch):
    found = []

    class Stopped(Exception):
        pass

    def train(config, *_, **__):
        found.append(config)
        if len(found) == len(training.default_configs()):
            raise Stopped
        folds = [0.5] * config.cv_folds
        return training.TrainedModel(config, None, None, {"cv_scores": folds, "cv_mean": 0.5, "cv_std": 0.0})

    monkeypatch.setattr(training, "train", train)
    with pytest.raises(Stopped):
        catalogue.QUERIES["catalog_cross_validation"](spark, FOLDER)
    named = training.default_configs()
    key = lambda c: (c.model_type, c.algorithm)
    assert sorted(found, key=key) == sorted(named.values(), key=key)
