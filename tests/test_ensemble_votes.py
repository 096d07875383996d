"""An ensemble's votes of several types come from one prediction of each member."""

from dataclasses import replace

import pytest

from dayprint.constants import FOOTPRINT
from dayprint.operators import ensemble, training
from dayprint.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_ensemble_predict_scores_each_member_once(spark, monkeypatch):
    fit, predict, calls = training.train, training.TrainedModel.predict, []

    def small(config, *args, **kwargs):
        fitted = fit(replace(config, hyperparameters={"n_estimators": 2, "max_depth": 2}), *args, **kwargs)
        calls.clear()
        return fitted

    def counted(model, df):
        calls.append(model.config.algorithm)
        return predict(model, df)

    monkeypatch.setattr(training, "train", small)
    monkeypatch.setattr(training.TrainedModel, "predict", counted)
    rows = catalogue.QUERIES["ensemble_predict"](spark, FOLDER).collect()
    assert calls == ["linear_regression", "random_forest"]
    assert len({r["record_id"] for r in rows}) == len(rows) > 0
    assert all(r["mean_is_mean"] and r["weighted_is_between"] for r in rows)


def test_votes_equal_those_of_single_ensembles(spark):
    class Member:
        def __init__(self, factor, score):
            self.model, self.metrics, self.factor = True, {"val_r2": score}, factor
            self.config = training.ModelConfig("regression", "linear_regression")

        def predict(self, df):
            return df.selectExpr("*", f"id * {self.factor} as {FOOTPRINT}_predicted")

    members, df = [Member(1.0, 0.9), Member(4.0, 0.3)], spark.range(5)
    both = ensemble.ModelEnsemble(members).with_votes(df, {"mean": "voting", "heavy": "weighted"}).orderBy("id").collect()
    for name, kind in (("mean", "voting"), ("heavy", "weighted")):
        alone = ensemble.ModelEnsemble(members, kind).predict(df).orderBy("id").collect()
        assert [r[name] for r in both] == [r[f"{FOOTPRINT}_predicted"] for r in alone]
    assert [r["mean"] for r in both] == [2.5 * i for i in range(5)]
    with pytest.raises(ValueError):
        ensemble.ModelEnsemble(members).with_votes(df, {"x": "unknown"})
