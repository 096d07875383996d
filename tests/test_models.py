import hashlib

import pytest
from pyspark.sql import functions as F

from dayprint.constants import FOOTPRINT, LEVEL, LEVELS
from dayprint.operators import attribution, evaluation, model_store, profile, scoring, stages
from dayprint.operators import training as T
from dayprint.operators.ensemble import ModelEnsemble
from dayprint.plans import baseline, train_job
from dayprint.plans.predictor import Predictor
from dayprint.sources.activity import activity, activity_raw
from dayprint.sources.samples import sample_input, sample_predictions, sample_suggestions
from dayprint.functions.validation import coerce_numeric

FOLDER = "/root/testdata/sf0.001"
SMALL = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    return baseline.split_activity(activity(spark, FOLDER)).cache()


@pytest.fixture(scope="module")
def model_folder(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    train_job.run(
        spark, train_job.prepare_features(rows.drop("split")), folder, "record_id",
        algorithms=("random_forest",), hyperparameters=SMALL,
    )
    return folder


@pytest.fixture(scope="module")
def store(spark, model_folder):
    return model_store.version_path(spark, model_folder)


@pytest.fixture(scope="module")
def predictor(spark, model_folder):
    return Predictor.load(spark, model_folder)


def test_store_is_complete(spark, store):
    names = model_store.list_artefacts(spark, store)
    assert names == [
        "best_classification_model", "best_regression_model", "classification_random_forest",
        "label_encoder", "metrics", "preprocessor", "regression_random_forest",
    ]
    registry = model_store.folder_registry(spark, store)
    audit = model_store.audit(registry).orderBy("position").collect()
    assert all(r["exists"] and r["loadable"] and r["error"] is None for r in audit)
    missing = model_store.audit(registry, ["preprocessor", "other"]).orderBy("position").collect()
    assert [r["error"] for r in missing] == [None, "File not found"]
    assert [r["name"] for r in model_store.filter_models(registry, "BEST").collect()]
    with pytest.raises(FileNotFoundError):
        model_store.load_model(spark, f"{store}/nothing")
    assert model_store.read_metrics(spark, f"{store}/nothing").count() == 0


def test_reloaded_model_predicts_the_same(spark, rows, store, predictor):
    again = model_store.load_model(spark, f"{store}/regression_random_forest")
    best = predictor.models["best_regression"]
    a = again.predict(rows).select("record_id", f"{FOOTPRINT}_predicted")
    b = best.predict(rows).select("record_id", f"{FOOTPRINT}_predicted")
    assert a.exceptAll(b).count() == 0


def test_scored_batch(spark, predictor):
    raw = coerce_numeric(activity_raw(spark, FOLDER))
    scored = predictor.score(raw).cache()
    assert scored.count() == raw.count()
    ok = scored.where("error is null")
    bad = scored.where("error is not null")
    assert bad.count() == scoring.quarantine(raw).where("not is_valid").count() > 0
    assert bad.where(f"{LEVEL} != 'Error' or {FOOTPRINT} is not null or suggestions is not null").count() == 0
    # Error rows keep their input.
    assert bad.where("distance_km = 150.0").count() > 0
    assert ok.where(f"not ({FOOTPRINT} between 1 and 20)").count() == 0
    assert ok.where("size(suggestions) > 3 or confidence not between 0 and 1").count() == 0
    total = "aggregate(map_values(probabilities), 0D, (a, x) -> a + x)"
    assert ok.where(f"abs({total} - 1) > 1e-9 or size(probabilities) != 3").count() == 0
    size = "aggregate(map_values(feature_contributions), 0D, (a, x) -> a + abs(x))"
    assert ok.where(f"abs({size} - 8) > 0.01").count() == 0
    once = predictor.score(raw, distinct=True)
    columns = ["record_id", FOOTPRINT, LEVEL]
    assert scored.select(*columns).exceptAll(once.select(*columns)).count() == 0


def test_service_and_explanations(spark, predictor):
    one = sample_input(spark)
    served = predictor.serve(one).first()
    assert served["confidence"] == pytest.approx(max(served["probabilities"].values()))
    assert served["validation"]["errors"] == []
    assert set(served["suggestions"][0].asDict()) == {"category", "suggestion", "potential_reduction"}
    core = predictor.explain(one).first()
    assert len(core["top_factors"]) == 3 and "Your daily" in core["explanation"]
    assert core["input_summary"]["transport"] == "Car (15.5 km)"
    service = predictor.explain(one, "service").first()
    assert len(service["percentage_contributions"]) == 5
    assert service["top_factors"][0]["description"]
    bad = predictor.validate_and_score(one.withColumn("distance_km", F.lit(150.0))).first()
    assert bad["error_messages"] == ["distance_km must be between 0 and 100"]
    assert bad[FOOTPRINT] is None and bad[LEVEL] == "Error"
    with pytest.raises(ValueError, match="Model nonexistent not found"):
        predictor.score(one, "nonexistent")


def test_score_csv(spark, predictor, tmp_path):
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    path.write_text(
        "eco_actions,day_type,transport_mode,distance_km,electricity_kwh,renewable_usage_pct,"
        "food_type,screen_time_hours,waste_generated_kg\n"
        "2,Weekday,Car,15.5,8.2,25.0,Mixed,6.5,0.75\n2,Weekday,Car,bad,8.2,25.0,Mixed,6.5,0.75\n"
    )
    scored = predictor.score_csv(spark, str(path), out)
    assert {r["error"] for r in scored.collect()} == {
        None, "Missing required field: distance_km",
    }
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert back.count() == 2 and back.where("suggestions = '[]' and confidence = '0.0'").count() == 1


def test_resolution_of_names():
    names = ["classification_a", "regression_a", "regression_b"]
    assert model_store.resolve_model(names, "regression") == "regression_a"
    assert model_store.resolve_model([*names, "best_regression"], "regression") == "best_regression"
    assert model_store.resolve_model(names, "regression", "regression_b") == "regression_b"
    assert model_store.resolve_model(names, "regression", "anything") == "regression_a"
    with pytest.raises(ValueError, match="Model regression_c not found"):
        model_store.resolve_model(names, "regression", "regression_c")
    with pytest.raises(ValueError, match="No regression models available"):
        model_store.resolve_model([], "regression")


def test_configurations():
    configs = T.default_configs()
    assert list(configs) == [
        "random_forest_reg", "xgboost_reg", "lightgbm_reg",
        "random_forest_clf", "xgboost_clf", "lightgbm_clf",
    ]
    changed = T.create_config("xgboost_reg", {"hyperparameters": {"max_depth": 3}, "cv_folds": 3})
    assert changed.hyperparameters == {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1}
    assert T.ModelConfig.from_dict(changed.to_dict()) == changed
    with pytest.raises(ValueError, match="Unknown model"):
        T.create_config("nothing")


@pytest.mark.parametrize("task,algorithm,message", [
    ("regression", "nothing", "Unknown regression algorithm"),
    ("classification", "nothing", "Unknown classification algorithm"),
    ("clustering", "random_forest", "Unknown model type"),
])
def test_unknown_algorithms(spark, task, algorithm, message):
    with pytest.raises(ValueError, match=message):
        T.build_estimator(T.ModelConfig(task, algorithm))


def test_training_metrics_and_folds(rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    config = T.ModelConfig("classification", "random_forest", SMALL, cv_folds=2)
    fitted = T.train(config, train, test, key="record_id")
    assert len(fitted.metrics["cv_scores"]) == 2
    assert 0.5 < fitted.metrics["train_accuracy"] <= 1
    assert fitted.metrics["val_accuracy"] > 0.5
    assert {r["class"] for r in fitted.metrics["val_report"]} >= {"accuracy", "macro avg"}
    again = T.train(config, train, test, key="record_id")
    assert again.metrics["cv_scores"] == fitted.metrics["cv_scores"]
    line = T.train(T.ModelConfig("regression", "linear_regression"), train, test)
    assert line.metrics["val_r2"] > 0.5
    with pytest.raises(ValueError, match="only available for classification"):
        line.predict_proba(test)
    unfitted = T.TrainedModel(config, fitted.preprocessor, None)
    with pytest.raises(ValueError, match="must be trained"):
        unfitted.predict(test)
    with pytest.raises(ValueError, match="All models in ensemble must be trained"):
        ModelEnsemble([fitted, unfitted]).predict(test)
    pair = ModelEnsemble([fitted, again])
    votes = pair.predict(test).select("record_id", f"{LEVEL}_predicted")
    alone = fitted.predict(test).select("record_id", f"{LEVEL}_predicted")
    assert votes.exceptAll(alone).count() == 0
    total = pair.predict_proba(test).selectExpr("aggregate(class_probabilities, 0D, (a, x) -> a + x) as t")
    assert total.where("abs(t - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="Unknown ensemble type"):
        ModelEnsemble([fitted], "stacking").predict(test)


def test_one_vs_rest_probabilities(rows):
    config = T.ModelConfig("classification", "xgboost", {"n_estimators": 2, "max_depth": 2},
                           feature_engineering=False)
    out = T.train(config, rows).predict(rows)
    bad = "abs(aggregate(class_probabilities, 0D, (a, x) -> a + x) - 1) > 1e-9"
    assert out.where(bad).count() == 0


def test_encoder(spark, rows):
    model = stages.create_preprocessor().fit(rows)
    names = stages.feature_names(model)
    assert len(names) == 16 and names[:6] == stages.NUMERIC_FEATURES
    assert names[6:] == [
        "day_type_Weekday", "day_type_Weekend", "transport_mode_Bike", "transport_mode_Bus",
        "transport_mode_Car", "transport_mode_EV", "transport_mode_Walk", "food_type_Mixed",
        "food_type_Non-Veg", "food_type_Veg",
    ]
    odd = sample_input(spark).withColumns(
        {"transport_mode": F.lit("Rocket"), "food_type": F.lit(None).cast("string")}
    )
    row = stages.transform_with_names(model, odd).first()
    assert sum(row[n] for n in names[6:]) == 1.0
    with pytest.raises(ValueError, match="Preprocessor not loaded"):
        stages.transform_with_names(stages.create_preprocessor(), odd)


def test_fit_time_transport_maximum(spark, rows, tmp_path):
    model = stages.FeatureEngineer(createInteractions=False).fit(rows)
    model.save(str(tmp_path / "m"))
    loaded = stages.FeatureEngineerModel.load(str(tmp_path / "m"))
    one = sample_input(spark)
    row = loaded.transform(one).first()
    assert row["sustainability_score"] == model.transform(one).first()["sustainability_score"]
    # Against its own maximum the only row would get no credit for its transport.
    own = stages.engineer_features(one).first()["sustainability_score"]
    assert row["sustainability_score"] > own
    assert "renewable_waste_interaction" not in row


def test_shapley_values_add_up(rows):
    config = T.ModelConfig("regression", "random_forest", SMALL, feature_engineering=False)
    fitted = T.train(config, rows)
    encoded = fitted.encode(rows.where("record_id < 20")).cache()
    centres = attribution.kmeans_background(fitted.encode(rows), k=2)
    parts = attribution.sampled_attribution(encoded, "record_id", fitted, centres, 2)
    sums = {r["record_id"]: r["s"] for r in
            parts.groupBy("record_id").agg(F.sum("attribution").alias("s")).collect()}
    from pyspark.ml.linalg import Vectors

    total = sum(n for _, n in centres)
    base = sum(fitted.model.predict(Vectors.dense(c)) * n / total for c, n in centres)
    for r in fitted.apply(encoded).collect():
        assert sums[r["record_id"]] == pytest.approx(r[f"{FOOTPRINT}_predicted"] - base, abs=1e-6)


def test_linear_attribution_adds_up(rows):
    weights = {"distance_km": 0.05, "electricity_kwh": 0.3}
    out = attribution.linear_attribution(rows, weights)
    means = out.agg(*[F.avg(f"attribution_{c}").alias(c) for c in weights]).first()
    assert [means[c] for c in weights] == pytest.approx([0, 0], abs=1e-9)


def test_metrics_of_degenerate_input(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    row = evaluation.regression_metrics(df, "y", "p").first()
    assert row["r2"] is None and row["mse"] == 0.5
    classes = spark.createDataFrame([("Low", "Low"), ("High", "Low")], "y string, p string")
    cells = evaluation.confusion_counts(classes, "y", "p")
    per = {r["class"]: r for r in evaluation.per_class_metrics(cells).collect()}
    assert per["High"]["precision"] == 0 and per["High"]["f1"] == 0 and per["Low"]["recall"] == 1
    dense = evaluation.confusion_matrix(classes, "y", "p")
    assert dense.count() == 9 and dense.agg(F.sum("n")).first()[0] == 2
    flat = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "distance_km double, carbon_footprint_kg double")
    found = {r["variable"]: r["correlation"] for r in
             profile.footprint_correlations(flat, ["distance_km", FOOTPRINT]).collect()}
    assert found == {"distance_km": None, FOOTPRINT: 1.0}


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame(
        [("Low", {"Low": 0.9, "High": 0.1}), ("Low", {"Low": 0.4, "High": 0.6})],
        "y string, p map<string,double>",
    )
    assert evaluation.roc_auc_ovr(df, "y", "p").first()[0] is None
    both = df.union(spark.createDataFrame([("High", {"Low": 0.4, "High": 0.6})], df.schema))
    areas = {r["class"]: r["roc_auc"] for r in evaluation.rank_auc(both, "y", "p").collect()}
    assert areas == {"Low": 0.75, "High": 0.75}


def test_analysis_of_four_predictions(spark):
    df = spark.createDataFrame(
        [(5.0, "Low", 0.9, None), (8.0, "Medium", 0.8, None), (12.0, "High", 0.85, None),
         (None, "Error", None, "Validation failed")],
        f"{FOOTPRINT} double, {LEVEL} string, confidence double, error string",
    )
    got = {(r["section"], r["name"]): r["value"] for r in profile.analyze_predictions(df).collect()}
    assert got[("totals", "success_rate")] == 75.0
    assert got[("totals", "failed_predictions")] == 1
    assert got[("footprint_statistics", "median")] == 8.0
    assert got[("footprint_statistics", "q1")] == 6.5
    assert {got[("impact_level_distribution", v)] for v in LEVELS} == {1.0}
    assert got[("confidence_statistics", "median")] == pytest.approx(0.85)
    assert got[("error_analysis", "Validation Error")] == 1
    nothing = {(r["section"], r["name"]): r["value"] for r in
               profile.analyze_predictions(df.where("false")).collect()}
    assert nothing == {("totals", "total_predictions"): 0, ("totals", "successful_predictions"): 0,
                       ("totals", "failed_predictions"): 0, ("totals", "success_rate"): 0}
    batch = {(r["section"], r["name"]): r["value"] for r in profile.analyze_batch(df).collect()}
    assert batch[("totals", "error_rate")] == 25.0
    assert batch[("impact_percentages", "Low")] == 25.0


def test_samples(spark, tmp_path):
    built_in = sample_predictions(spark)
    assert built_in.count() == 2
    (tmp_path / "s.json").write_text(
        '[{"input": {"transport_mode": "Car"}, "output": {"carbon_impact_level": "High",\n'
        ' "suggestions": [{"category": "Energy", "action": "a"}, {"category": "Food"}]}}]'
    )
    read = sample_predictions(spark, str(tmp_path / "s.json"))
    rows = sample_suggestions(read, "input").orderBy("position").collect()
    assert [r["category"] for r in rows] == ["Energy", "Food"]


def test_hot_inputs_are_scored_once(spark, sample, records):
    # One input holds more than a third of all rows.
    df = records(*[sample] * 40, *[{**sample, "distance_km": i} for i in range(60)])
    df = df.union(records({**sample, "food_type": None}))
    seen = []

    def scorer(rows):
        seen.append(rows.count())
        return rows.withColumn(FOOTPRINT, F.coalesce("distance_km", F.lit(0.0)) * 2)

    scored = scoring.score_distinct(df, scorer)
    assert seen == [62]
    assert scored.count() == 101
    assert scored.where(f"{FOOTPRINT} != distance_km * 2").count() == 0
    stats = scoring.repeat_statistics(df).first()
    assert (stats["rows"], stats["distinct_inputs"], stats["hits"]) == (101, 62, 39)


def test_score_distinct_keeps_every_row(spark):
    """-0.0, null, NaN, one hot input and copies: as many rows out as in, scored as directly."""
    values = [0.0, -0.0, None, float("nan"), float("inf"), 2.5] * 40 + [7.0] * 500 + [float(i) for i in range(30)]
    df = spark.createDataFrame([(i, v, "a" if i % 2 else None) for i, v in enumerate(values)], "id bigint, x double, c string")
    scorer = lambda d: d.withColumn("y", F.coalesce(F.nanvl("x", F.lit(-1.0)) + 1, F.lit(-2.0)))
    got = {r["id"]: r["y"] for r in scoring.score_distinct(df, scorer, ["x", "c"]).collect()}
    want = {r["id"]: r["y"] for r in scorer(df).collect()}
    assert got == want and len(got) == len(values)


def test_score_distinct_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), "a") for i in range(200)], "id bigint, x double, c string")
    scorer = lambda d: d.withColumn("y", F.col("x") * 2)
    results = []
    for share in (0.0, 0.1429, 2.0):  # all hot, some hot, none hot
        monkeypatch.setattr(scoring, "HOT_SHARE", share)
        results.append({r["id"]: r["y"] for r in scoring.score_distinct(df, scorer, ["x", "c"]).collect()})
    assert results[0] == results[1] == results[2] and len(results[0]) == 200


def test_deep_trees_are_refused():
    for params in ({"max_depth": 64}, {"num_leaves": 2**40}):
        with pytest.raises(ValueError, match="depth"):
            T.build_estimator(T.ModelConfig("regression", "random_forest", params))


def test_rows_outside_all_folds_are_refused(spark, rows):
    config = T.ModelConfig("regression", "linear_regression", cv_folds=2)
    encoded = rows.select(F.lit(None).cast("int").alias("fold"))
    with pytest.raises(ValueError, match="folds"):
        T.cross_validate(config, None, encoded)


def test_auc_of_crowded_scores(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SCORES_PER_RANGE", 2000)
    df = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'High', 'Low') as y", "map('High', (id * 7919 % 20000 + if(id % 3 = 0, 3000, 0)) / 2e9) as p"
    )
    (got,) = evaluation.rank_auc(df, "y", "p").collect()
    import pandas as pd

    t = df.selectExpr("y", "p['High'] as s").toPandas()
    rank = t["s"].rank()
    pos = t["y"] == "High"
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert got["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_a_segment_in_one_fold_gets_the_other_folds_mean(spark):
    from dayprint.plans.catalogue import _cross_validated

    rows = [("Car", "Veg", 4.0, 0), ("Car", "Veg", 6.0, 1), ("Bus", "Veg", 9.0, 1), ("Sled", "Veg", 1.0, 0)]
    df = spark.createDataFrame(rows, f"transport_mode string, food_type string, {FOOTPRINT} double, fold int")
    got = {(r["transport_mode"], r["fold"]): r["pred"] for r in _cross_validated(df).collect()}
    assert got == {("Car", 0): 6.0, ("Car", 1): 4.0, ("Bus", 1): 4.0, ("Sled", 0): 7.5}


def test_clusters_need_a_shared_folder():
    from dayprint.sources.workdir import shared_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session())


def test_scatter_sample_takes_the_least_hashes(spark):
    """A large stratum through its limit, a small one and a null one whole, rows without a value left out."""
    rows = [(i, "Low" if i % 10 else "High", float(i), 1.0) for i in range(3000)]
    rows += [(5000 + i, None, 1.0, 2.0) for i in range(3)] + [(6000, "Low", None, 1.0)]
    df = spark.createDataFrame(rows, f"record_id long, {LEVEL} string, renewable_usage_pct double, {FOOTPRINT} double")
    got = {(r[LEVEL], r["rank"]): r["record_id"] for r in profile.scatter_sample(df, "record_id", 40).collect()}
    want = {}
    for level in ("Low", "High", None):
        keys = [i for i, s, x, _ in rows if s == level and x is not None]
        keys.sort(key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        want.update({(level, n + 1): i for n, i in enumerate(keys[:40])})
    assert got == want and len(got) == 83
    assert profile.scatter_sample(df.limit(0), "record_id", 5).count() == 0
