"""Every operator as a named query over the given tables."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dayprint.constants import (
    CATEGORICAL_FEATURES,
    FEATURES,
    FOOTPRINT,
    LEVEL,
    LEVELS,
    NUMERIC_FEATURES,
    REQUIRED_ARTEFACTS,
)
from dayprint.functions import confidence as conf
from dayprint.functions import contributions as contrib
from dayprint.functions import features as X
from dayprint.functions import validation as V
from dayprint.functions.explanations import explanation, service_explanation
from dayprint.functions.plausibility import plausibility
from dayprint.functions.suggestions import suggestions
from dayprint.operators import attribution, ensemble, evaluation, model_store, profile
from dayprint.operators import scoring, splits, stages, training
from dayprint.operators.spread import stored
from dayprint.plans import baseline
from dayprint.schema import ACTIVITY_SCHEMA, SAMPLE_SCHEMA
from dayprint.sources import files
from dayprint.sources.activity import EVENTS_SCHEMA, activity, activity_raw, from_events
from dayprint.sources.samples import sample_suggestions
from dayprint.sources.workdir import materialise, new_folder
from dayprint.streaming.score_stream import read_stream, running_counts, score_stream, score_stream_once, scored_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to six places, to compare across engines."""
    return df.select(
        *[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
          for f in df.schema.fields]
    )


def coerced(spark: SparkSession, folder: str, keep: list[str] = []) -> DataFrame:
    return V.coerce_numeric(activity_raw(spark, folder, keep))


def test_rows(spark: SparkSession, folder: str) -> DataFrame:
    return baseline.predictions(activity(spark, folder)).where(F.col("split") == "test")


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = baseline.split_activity(activity(spark, folder))
    return rows.where(F.col("split") == "train").drop("split")


def timestamp() -> Column:
    return F.lit("2024-01-15 12:30:45").cast("timestamp")


# --- Sources and sinks -------------------------------------------------------


@query
def read_activity(spark, folder):
    path = new_folder(spark, "activity-csv")
    rows = activity(spark, folder).select(*ACTIVITY_SCHEMA.names)
    rows.write.option("header", True).csv(path)
    return files.read_activity(spark, path)


@query
def required_columns(spark, folder):
    # Records as a producer with an older schema would send them.
    sent = activity_raw(spark, folder).drop("waste_generated_kg", "food_type")
    fields = [c for c in FEATURES if c in sent.columns]
    return files.column_presence(sent.select(F.to_json(F.struct(*fields)).alias("record")))


@query
def records_to_frame(spark, folder):
    raw = activity_raw(spark, folder)
    return files.records_to_frame(
        raw.select("record_id", F.to_json(F.struct(*FEATURES)).alias("record"))
    )


@query
def write_scored(spark, folder):
    rows = activity(spark, folder)
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    scored = scoring.score_batch(rows, scorer, profile.target_stats(rows), timestamp())
    path = new_folder(spark, "scored-csv")
    files.write_scored(
        scored.select("record_id", FOOTPRINT, LEVEL, "confidence", "suggestions", "error"),
        path,
        "csv",
    )
    schema = (
        f"record_id bigint, {FOOTPRINT} double, {LEVEL} string, confidence double, "
        "suggestions string, error string"
    )
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return rounded(back)


@query
def save_load_models(spark, folder):
    rows = baseline.split_activity(activity(spark, folder))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh"], []).fit(train)
    fitted = training.train(config, train, preprocessor=encoder)
    store = new_folder(spark, "models")
    model_store.save_model(spark, fitted, store)
    loaded = model_store.load_all(spark, store)["regression_linear_regression"]
    return loaded.predict(test).select(
        "record_id", F.round(f"{FOOTPRINT}_predicted", 5).alias("prediction")
    )


@query
def model_versions(spark, folder):
    """A reader that holds the first version, and one that comes after the second was published."""
    rows = baseline.split_activity(activity(spark, folder))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    store = new_folder(spark, "versions")

    def publish(column: str) -> str:
        encoder = stages.create_preprocessor([column], []).fit(train)
        config = training.ModelConfig("regression", "linear_regression")
        fitted = training.train(config, train, preprocessor=encoder)
        return model_store.publish_models(spark, {fitted.name: fitted}, store)

    publish("electricity_kwh")
    held = model_store.version_path(spark, store)
    publish("distance_km")
    read = []
    for version, path in enumerate((held, model_store.version_path(spark, store)), 1):
        model = model_store.load_all(spark, path)["regression_linear_regression"]
        read.append(
            model.predict(test).select(
                F.lit(version).alias("version"), "record_id", F.round(f"{FOOTPRINT}_predicted", 5).alias("prediction")
            )
        )
    return read[0].unionByName(read[1])


def baseline_metrics(spark, folder) -> DataFrame:
    """Tidy test metrics of both simple models."""
    rows = baseline.long_predictions(activity(spark, folder)).where("split = 'test'")
    wide = evaluation.regression_metrics(rows, "label", "prediction", ["algorithm"])
    return wide.select(
        F.lit("regression").alias("task"), F.col("algorithm").alias("model"), "rmse", "r2", "mae"
    ).unpivot(["task", "model"], ["rmse", "r2", "mae"], "metric", "value")


@query
def metrics_store(spark, folder):
    path = new_folder(spark, "metrics")
    model_store.write_metrics(rounded(baseline_metrics(spark, folder)), path)
    return model_store.read_metrics(spark, path)


def baseline_registry(spark, folder) -> DataFrame:
    metrics = baseline_metrics(spark, folder)
    return metrics.groupBy(F.concat("task", F.lit("_"), "model").alias("name")).agg(
        F.bool_and(F.col("value").isNotNull()).alias("loadable"),
        F.when(F.bool_or(F.col("value").isNull()), "Model has no metrics").alias("error"),
    )


@query
def artefact_audit(spark, folder):
    required = ["regression_linear", "regression_segment", *REQUIRED_ARTEFACTS]
    return model_store.audit(baseline_registry(spark, folder), required)


@query
def golden_samples(spark, folder):
    rows = activity(spark, folder)
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    scored = scoring.score_batch(rows, scorer, None, timestamp())
    output = F.struct(FOOTPRINT, LEVEL, "confidence", "probabilities", "suggestions")
    path = new_folder(spark, "samples")
    scored.select(
        "record_id", F.struct(*FEATURES).alias("input"), output.alias("output")
    ).write.json(path)
    schema = T.StructType([T.StructField("record_id", T.LongType()), *SAMPLE_SCHEMA.fields])
    stored = spark.read.schema(schema).json(path).withColumns(
        {
            "transport_mode": F.col("input.transport_mode"),
            FOOTPRINT: r6(f"output.{FOOTPRINT}"),
            "p_high": r6(F.expr("output.probabilities['High']")),
        }
    )
    keep = ("record_id", "transport_mode", FOOTPRINT, "p_high")
    return sample_suggestions(stored, *keep).select(*keep, "position", "category", "action")


@query
def model_info(spark, folder):
    metrics = baseline_metrics(spark, folder)
    wide = metrics.groupBy("task", "model").pivot("metric", ["r2", "rmse"]).agg(F.first("value"))
    best = evaluation.best_model(wide, "r2", "model").select("task", "model")
    registry = model_store.filter_models(baseline_registry(spark, folder), "REGRESS")
    return rounded(model_store.model_info(registry, wide, best))


# --- Projection and validation -----------------------------------------------


@query
def features_targets(spark, folder):
    return activity(spark, folder).select("record_id", *FEATURES, FOOTPRINT, LEVEL)


@query
def columns_by_dtype(spark, folder):
    rows = activity(spark, folder).select(*FEATURES, FOOTPRINT, LEVEL)
    kinds = profile.column_kinds(rows)
    counted = rows.agg(*[F.count(c).alias(c) for c in kinds])
    kind = F
    for name, value in kinds.items():
        kind = kind.when(F.col("column_name") == name, value)
    return counted.unpivot([], list(kinds), "column_name", "non_null").withColumn("kind", kind)


@query
def coerce_numeric(spark, folder):
    return coerced(spark, folder).select("record_id", *NUMERIC_FEATURES)


@query
def null_fill_missing(spark, folder):
    partial = activity(spark, folder).drop("waste_generated_kg", "day_type", FOOTPRINT, LEVEL)
    return V.fill_missing_columns(partial).drop("activity_date", "user_id")


def _messages(spark, folder, errors: list[str]) -> DataFrame:
    return coerced(spark, folder).selectExpr(
        "record_id", f"concat_ws('; ', {', '.join(errors)}) as messages"
    )


@query
def check_required(spark, folder):
    return _messages(spark, folder, V.missing_field_errors())


@query
def check_domain(spark, folder):
    return _messages(spark, folder, V.domain_errors())


@query
def check_range(spark, folder):
    return _messages(spark, folder, V.range_errors())


@query
def validate_all(spark, folder):
    checked = coerced(spark, folder).withColumn("errors", V.validation_errors())
    return checked.select(
        "record_id",
        (F.size("errors") == 0).alias("is_valid"),
        F.size("errors").alias("n_errors"),
        F.concat_ws("; ", "errors").alias("messages"),
    )


@query
def validate_first(spark, folder):
    return coerced(spark, folder).select("record_id", V.first_error().alias("error"))


@query
def quarantine(spark, folder):
    return scoring.quarantine(coerced(spark, folder)).select(
        "record_id", "is_valid", "error", FOOTPRINT, LEVEL, "transport_mode", "distance_km"
    )


@query
def quarantine_service(spark, folder):
    return scoring.quarantine(coerced(spark, folder), "service").select(
        "record_id", "is_valid", "error", LEVEL
    )


@query
def impact_level(spark, folder):
    rows = activity(spark, folder).withColumn(
        FOOTPRINT, F.when(F.col("record_id") % 50 != 0, F.col(FOOTPRINT))
    )
    narrow = X.impact_level(FOOTPRINT, 5.0, 9.0).alias("narrow_level")
    return stages.ImpactLeveller().transform(rows).select("record_id", LEVEL, narrow)


# --- Features and encoding ---------------------------------------------------


def _feature(name: str, column: Callable[[], Column]) -> None:
    def run(spark, folder):
        return rounded(coerced(spark, folder).select("record_id", column().alias(name)))

    run.__name__ = name
    query(run)


_feature("transport_impact_score", X.transport_impact_score)
_feature("energy_efficiency", X.energy_efficiency)
_feature("waste_per_activity", X.waste_per_activity)
_feature("transport_electricity_interaction", X.transport_electricity_interaction)
_feature("renewable_waste_interaction", X.renewable_waste_interaction)
_feature("is_weekend", X.is_weekend)
_feature("renewable_bucket", X.renewable_bucket)
_feature("log_distance", X.log_distance)


@query
def sustainability_score(spark, folder):
    rows = activity(spark, folder)
    score = X.sustainability_score(stages.max_transport_score(rows))
    return rows.select("record_id", r6(score).alias("sustainability_score"))


@query
def engineer_features(spark, folder):
    train = train_rows(spark, folder)
    model = stages.FeatureEngineer(createInteractions=True).fit(train)
    added = model.transform(activity(spark, folder)).drop(
        "user_id", "activity_date", *FEATURES, FOOTPRINT, LEVEL
    )
    return rounded(added)


@query
def impute_median(spark, folder):
    return rounded(
        stages.impute_median(coerced(spark, folder)).select("record_id", *NUMERIC_FEATURES)
    )


@query
def impute_constant(spark, folder):
    return stages.impute_constant(coerced(spark, folder)).select(
        "record_id", *CATEGORICAL_FEATURES
    )


@query
def standard_scale(spark, folder):
    return rounded(
        stages.standard_scale(activity(spark, folder)).select("record_id", *NUMERIC_FEATURES)
    )


def _encoded(spark, folder) -> DataFrame:
    model = stages.create_preprocessor().fit(activity(spark, folder))
    return stages.transform_with_names(model, coerced(spark, folder), ["record_id"])


@query
def one_hot(spark, folder):
    frame = _encoded(spark, folder)
    return frame.drop(*NUMERIC_FEATURES).withColumnsRenamed(
        {c: c.replace("-", "_") for c in frame.columns}
    )


@query
def preprocess(spark, folder):
    frame = _encoded(spark, folder)
    return rounded(
        frame.withColumnsRenamed({c: c.replace("-", "_") for c in frame.columns})
    )


@query
def feature_names(spark, folder):
    frame = _encoded(spark, folder).drop("record_id")
    names = frame.columns
    means = frame.agg(*[r6(F.avg(f"`{c}`")).alias(c) for c in names])
    slot = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    return means.unpivot([], names, "feature", "mean").withColumn("slot", slot.cast("int"))


@query
def label_codec(spark, folder):
    rows = activity(spark, folder)
    codec = model_store.label_codec(spark)
    indexed = codec.transform(rows)
    # Class numbers from a wider model: 3 and 4 are unknown.
    wide = (F.col("record_id") % 5).cast("double")
    return indexed.select(
        "record_id",
        "label",
        stages.level_index(F.col(LEVEL)).alias("label_by_rule"),
        stages.index_level(wide).alias("decoded"),
    )


# --- Splits ------------------------------------------------------------------


@query
def stratified_split(spark, folder):
    return splits.stratified_split(activity(spark, folder), "record_id").select(
        "record_id", LEVEL, "split"
    )


@query
def hash_split(spark, folder):
    return splits.hash_split(activity(spark, folder), "record_id").select("record_id", "split")


def _cross_validated(folded: DataFrame) -> DataFrame:
    """Rows with the segment mean over all other folds, from one set of sums."""
    keys = baseline.SEGMENT
    by_fold = folded.groupBy(*keys, "fold").agg(
        F.sum(FOOTPRINT).alias("s"), F.count(FOOTPRINT).alias("n")
    )
    # Known segments only: 15 segments times 5 folds at most.
    by_fold = materialise(by_fold.where(baseline.KNOWN_SEGMENT), "fold-sums")
    totals = by_fold.groupBy(*keys).agg(F.sum("s").alias("total"), F.sum("n").alias("rows"))
    whole = by_fold.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    per_fold = by_fold.groupBy("fold").agg(F.sum("s").alias("fold_s"), F.sum("n").alias("fold_n"))
    mean = F.try_divide(whole.select("all_s").scalar() - F.col("fold_s"), whole.select("all_n").scalar() - F.col("fold_n"))
    others = by_fold.join(F.broadcast(totals), keys).select(
        *keys, "fold", r6(F.try_divide(F.col("total") - F.col("s"), F.col("rows") - F.col("n"))).alias("own")
    )
    # A segment that lives in one fold only gets the mean of the other folds.
    fallback = per_fold.select("fold", r6(mean).alias("mean"))
    joined = folded.join(F.broadcast(others), [*keys, "fold"], "left").join(F.broadcast(fallback), "fold", "left")
    return joined.withColumn("pred", F.coalesce("own", "mean")).drop("own", "mean")


@query
def kfold_regression(spark, folder):
    rows = _cross_validated(splits.contiguous_folds(activity(spark, folder), "record_id"))
    return rounded(
        evaluation.regression_metrics(rows, FOOTPRINT, "pred", ["fold"]).select("fold", "n", "r2")
    )


@query
def kfold_classification(spark, folder):
    rows = _cross_validated(splits.stratified_folds(activity(spark, folder), "record_id"))
    hit = F.when(X.impact_level("pred") == F.col(LEVEL), 1.0).otherwise(0.0)
    return rounded(
        rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    )


@query
def kfold_summary(spark, folder):
    scores = kfold_regression(spark, folder)
    return rounded(scores.agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std")))


@query
def stratified_folds(spark, folder):
    return splits.stratified_folds(activity(spark, folder), "record_id").select(
        "record_id", "fold"
    )


@query
def validation_metrics(spark, folder):
    rows = baseline.predictions(activity(spark, folder))
    regression = evaluation.regression_metrics(rows, FOOTPRINT, "segment_mean", ["split"])
    hit = F.when(F.col("segment_level") == F.col(LEVEL), 1.0).otherwise(0.0)
    accuracy = rows.groupBy("split").agg(F.avg(hit).alias("accuracy"))
    # Two rows on each side.
    return rounded(
        regression.select("split", "n", "rmse", "r2").join(F.broadcast(accuracy), "split")
    )


# --- Estimators --------------------------------------------------------------


def _fit_and_score(spark, folder, task: str, algorithm: str, parameters: dict | None = None):
    """Test rows with the prediction of a model in the library's settings, or with the given ones."""
    rows = baseline.split_activity(activity(spark, folder))
    config = training.ModelConfig(task, algorithm, dict(parameters or {}), feature_engineering=False)
    fitted = training.train(config, rows.where("split = 'train'"), measure=False)
    return fitted.predict(rows.where("split = 'test'"))


# What a fit promises whatever its details, so that SQL can check every record: a
# tree's prediction is a mean of training labels, probabilities add up to one and
# the level is the likeliest one.


def _in_range(train: DataFrame, prediction: str) -> Column:
    lo, hi = (train.agg(f(FOOTPRINT)).scalar() for f in (F.min, F.max))
    return F.col(prediction).between(lo - 1e-6, hi + 1e-6)


def _sums_to_one(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.abs(total - 1) < 1e-6) & (F.array_min(p) >= 0)


def _likeliest(p: Column, level: str) -> Column:
    labels = F.array(*[F.lit(v) for v in LEVELS])
    chosen = F.get(p, F.array_position(labels, F.col(level)).cast("int") - 1)
    return chosen >= F.array_max(p) - 1e-9


def _regressor(name: str, algorithm: str) -> None:
    def run(spark, folder):
        out = _fit_and_score(spark, folder, "regression", algorithm)
        inside = _in_range(train_rows(spark, folder), f"{FOOTPRINT}_predicted")
        return out.select("record_id", inside.alias("in_training_range"))

    run.__name__ = name
    query(run)


def _classifier(name: str, algorithm: str) -> None:
    def run(spark, folder):
        out = _fit_and_score(spark, folder, "classification", algorithm)
        p, level = F.col("class_probabilities"), f"{LEVEL}_predicted"
        return out.select(
            "record_id",
            F.col(level).isin(LEVELS).alias("known_level"),
            _sums_to_one(p).alias("sums_to_one"),
            _likeliest(p, level).alias("likeliest"),
        )

    run.__name__ = name
    query(run)


_regressor("rf_regressor", "random_forest")
_classifier("rf_classifier", "random_forest")
_classifier("gbt_classifier", "xgboost")


@query
def gbt_regressor(spark, folder):
    """Squared-loss boosting: on the training rows the mean prediction is the mean label."""
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "xgboost", feature_engineering=False)
    predicted = training.train(config, train, measure=False).predict(train)
    return predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(f"{FOOTPRINT}_predicted"), 4).alias("mean_prediction"),
        F.round(F.avg(FOOTPRINT), 4).alias("mean_label"),
    )


@query
def robust_regressor(spark, folder):
    """Robust fits, linear and with a kernel: nearer to the labels than the training mean, and the kernel nearer still."""
    rows = stored(baseline.split_activity(activity(spark, folder)))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    encoder = stages.create_preprocessor().fit(train)
    mean = train.agg(F.avg(FOOTPRINT)).scalar()
    for kernel in ("linear", "rbf"):
        config = training.ModelConfig("regression", "svr", {"kernel": kernel}, feature_engineering=False)
        fitted = training.train(config, train, preprocessor=encoder, measure=False)
        test = fitted.predict(test).withColumnRenamed(f"{FOOTPRINT}_predicted", kernel)
    off = lambda c: F.avg(F.abs(F.col(FOOTPRINT) - c))
    found = test.withColumn("mean", mean).agg(F.count(F.lit(1)).alias("n"), *[off(F.col(c)).alias(c) for c in ("mean", "linear", "rbf")])
    return found.select("n", (F.col("linear") < F.col("mean")).alias("linear_beats_mean"), (F.col("rbf") < F.col("mean")).alias("kernel_beats_mean"))


@query
def logistic_regression(spark, folder):
    """Unregularised multinomial fit: each class's probabilities add up to its rows."""
    train = train_rows(spark, folder)
    config = training.ModelConfig("classification", "logistic_regression", feature_engineering=False)
    predicted = training.train(config, train).predict(train)
    sums = predicted.agg(
        *[F.sum(F.get("class_probabilities", F.lit(i))).alias(v) for i, v in enumerate(LEVELS)]
    ).unpivot([], LEVELS, "level", "expected")
    counts = train.groupBy(F.col(LEVEL).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    # One row per level on both sides.
    return counts.join(F.broadcast(sums), "level").select(
        "level", "n", (F.abs(F.col("expected") - F.col("n")) < 0.5 + 0.005 * F.col("n")).alias("meets_count")
    )


@query
def linear_svc(spark, folder):
    out = _fit_and_score(spark, folder, "classification", "svc", {"kernel": "linear"})
    p = F.col("class_probabilities")
    return out.select(
        "record_id", F.col(f"{LEVEL}_predicted").isin(LEVELS).alias("known_level"), _sums_to_one(p).alias("sums_to_one")
    )


@query
def kernel_svc(spark, folder):
    """A kernel machine with probabilities: per level its mean probability and its share of the test rows."""
    out = _fit_and_score(spark, folder, "classification", "svc", {"components": 64})
    hits = F.avg((F.col(f"{LEVEL}_predicted") == F.col(LEVEL)).cast("double"))
    own = F.get("class_probabilities", F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.col(LEVEL)).cast("int") - 1)
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        (hits > 0.5).alias("beats_half"),
        F.count_if(_sums_to_one(F.col("class_probabilities"))).alias("sum_to_one"),
        (F.avg(own) > 1 / 3).alias("own_class_likelier"),
    )


@query
def svc_probabilities(spark, folder):
    """The two equations of each class's logistic curve over out-of-fold margins: residuals add up to zero, also times the margin."""
    train = stored(train_rows(spark, folder))
    config = training.ModelConfig("classification", "svc", {"kernel": "linear"}, feature_engineering=False)
    encoder = stages.create_preprocessor().fit(train)
    encoded = stored(training.with_label(encoder.transform(train), "classification").select("label", "features"))
    margins = training.out_of_fold_margins(training.build_estimator(config), encoded)
    curves = training.platt_scaling(margins, len(LEVELS))
    classes = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(float(i)).alias("class"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (v, (a, b)) in enumerate(zip(LEVELS, curves))])
    rows = margins.select("label", "margins", F.inline(classes))
    margin = F.get("margins", F.col("class").cast("int"))
    residual = 1 / (1 + F.exp(-(F.col("a") * margin + F.col("b")))) - (F.col("label") == F.col("class")).cast("double")
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == F.col("class")).alias("of_level"),
        F.round(F.abs(F.avg(residual)), 4).alias("mean_residual"),
        F.round(F.abs(F.avg(residual * margin)), 4).alias("mean_weighted_residual"),
    )


@query
def linear_regression(spark, folder):
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh"], [], scale=False).fit(train)
    model = training.train(config, train, preprocessor=encoder).model
    # Coefficients next to the same figures from one aggregation.
    return train.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(FOOTPRINT, "electricity_kwh"), 5).alias("slope"),
        F.round(F.regr_intercept(FOOTPRINT, "electricity_kwh"), 5).alias("intercept"),
    ).withColumns(
        {
            "fitted_slope": F.round(F.lit(float(model.coefficients[0])), 5),
            "fitted_intercept": F.round(F.lit(float(model.intercept)), 5),
        }
    )


@query
def train_all(spark, folder):
    rows = baseline.split_activity(activity(spark, folder))
    models = training.train_all(rows.where("split = 'train'"))
    found = training.evaluate_all(models, rows.where("split = 'test'"))
    spread = rows.where("split = 'test'").agg(F.stddev_pop(FOOTPRINT)).scalar()
    # Better than predicting the mean, or than guessing a level.
    good = (
        F.when(F.col("metric") == "rmse", F.col("value") < spread)
        .when(F.col("metric") == "mse", F.col("value") < spread * spread)
        .when(F.col("metric") == "r2", F.col("value").between(0, 1))
        .otherwise(F.col("value").between(1 / 3, 1))
    )
    return found.select("task", "model", "metric", good.alias("beats_guessing"))


@query
def model_catalog(spark, folder):
    """Every named configuration with its training score."""
    train = stored(train_rows(spark, folder))
    # Cross-validation has queries of its own.
    settings = {"use_cross_validation": False}
    encoder = stages.create_preprocessor(engineer=True).fit(train)

    def score(name: str) -> tuple[str, str, float]:
        fitted = training.train(training.create_config(name, settings), train, None, encoder)
        metric = "train_r2" if fitted.config.model_type == "regression" else "train_accuracy"
        return name, metric, fitted.metrics[metric]

    # Boosting runs many short jobs one after the other; two fits at a time fill the cores.
    with ThreadPoolExecutor(2) as pool:
        scores = list(pool.map(score, training.default_configs()))
    frame = spark.createDataFrame(scores, "name string, metric string, score double")
    listed = training.catalog_frame(spark).join(F.broadcast(frame), "name")
    return listed.select(
        "name", "model_type", "algorithm", "hyperparameter", "value", "metric",
        F.col("score").between(0.4, 1).alias("beats_guessing"),
    )


@query
def best_model(spark, folder):
    wide = baseline_metrics(spark, folder).groupBy("task", "model").pivot(
        "metric", ["r2", "rmse", "mae"]
    ).agg(F.first("value"))
    return rounded(
        evaluation.best_model(wide, "r2", "model")
        .withColumn("chosen_by", F.lit("r2"))
        .unionByName(
            evaluation.best_model(wide, "rmse", "model", higher_is_better=False).withColumn(
                "chosen_by", F.lit("rmse")
            )
        )
    )


# --- Scoring and ensembles ---------------------------------------------------


@query
def score_footprint(spark, folder):
    rows = baseline.split_activity(activity(spark, folder))
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh"], []).fit(
        rows.where("split = 'train'")
    )
    fitted = training.train(config, rows.where("split = 'train'"), preprocessor=encoder)
    return fitted.predict(rows).select(
        "record_id", F.round(f"{FOOTPRINT}_predicted", 5).alias(FOOTPRINT)
    )


@query
def score_level(spark, folder):
    out = _fit_and_score(spark, folder, "classification", "random_forest")
    p, level = F.col("class_probabilities"), F.col(f"{LEVEL}_predicted")
    chosen = F.element_at(scoring.probability_map(p, level), level)
    return out.select(
        "record_id",
        level.isin(LEVELS).alias("known_level"),
        (F.abs(chosen - conf.class_confidence(p)) < 1e-9).alias("confidence_is_its_probability"),
    )


def _class_probabilities() -> Column:
    return F.array("p_low", "p_medium", "p_high")


@query
def regression_confidence(spark, folder):
    stats = profile.target_stats(train_rows(spark, folder))
    partial = {"mean": stats["mean"]}
    rows = test_rows(spark, folder)
    pred = F.col("linear_pred")
    return rounded(
        rows.select(
            "record_id",
            conf.regression_confidence(pred, stats).alias("confidence"),
            conf.regression_confidence(pred, partial).alias("confidence_with_defaults"),
            conf.regression_confidence(pred, None).alias("confidence_without_stats"),
        )
    )


@query
def class_confidence(spark, folder):
    return rounded(
        test_rows(spark, folder).select(
            "record_id",
            conf.class_confidence(_class_probabilities()).alias("confidence"),
            conf.class_confidence(F.lit(None).cast("array<double>")).alias("without_probabilities"),
        )
    )


@query
def overall_confidence(spark, folder):
    stats = profile.target_stats(train_rows(spark, folder))
    return rounded(
        test_rows(spark, folder).select(
            "record_id",
            conf.overall_confidence(
                conf.regression_confidence(F.col("segment_mean"), stats),
                conf.class_confidence(_class_probabilities()),
            ).alias("confidence"),
        )
    )


@query
def service_confidence(spark, folder):
    rows = activity(spark, folder)
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    return rounded(
        scoring.score_batch(rows, scorer, None, timestamp(), "service").select(
            "record_id", "confidence"
        )
    )


@query
def resolve_model(spark, folder):
    names = [r["name"] for r in baseline_registry(spark, folder).orderBy("name").collect()]
    pred_of = {"regression_linear": "linear_pred", "regression_segment": "segment_mean"}
    chosen = {
        "best": model_store.resolve_model(names, "regression"),
        "exact": model_store.resolve_model(names, "regression", "regression_segment"),
        "other": model_store.resolve_model(names, "regression", "anything"),
    }
    return test_rows(spark, folder).select(
        "record_id", *[r6(pred_of[name]).alias(request) for request, name in chosen.items()]
    )


@query
def score_batch(spark, folder):
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    stats = profile.target_stats(train_rows(spark, folder))
    scored = scoring.score_batch(coerced(spark, folder), scorer, stats, timestamp())
    return rounded(
        scored.select(
            "record_id",
            FOOTPRINT,
            LEVEL,
            "confidence",
            "regression_confidence",
            "classification_confidence",
            F.to_json("suggestions").alias("suggestions"),
            F.col("feature_contributions")["transport"].alias("transport"),
            "input_summary.energy",
            "timestamp",
            "error",
        )
    )


@query
def score_batch_ml(spark, folder):
    train = stored(train_rows(spark, folder))
    models = training.train_all(train, ("random_forest",), engineer=False)
    scorer = training.ml_scorer(
        models["regression_random_forest"], models["classification_random_forest"]
    )
    stats = profile.target_stats(train)
    scored = scoring.score_batch(coerced(spark, folder), scorer, stats, timestamp())
    valid = F.col("error").isNull()
    level = F.col(LEVEL)
    return scored.select(
        "record_id",
        "error",
        F.when(valid, _in_range(train, FOOTPRINT)).alias("in_training_range"),
        F.when(valid, level.isin(LEVELS)).otherwise(level == "Error").alias("known_level"),
        F.when(valid, F.col("confidence").between(0, 1)).alias("is_confidence"),
    )


@query
def input_summary(spark, folder):
    s = conf.input_summary()
    return activity(spark, folder).select("record_id", s.alias("s")).select(
        "record_id",
        "s.transport",
        "s.energy",
        "s.food",
        "s.lifestyle.screen_time",
        "s.lifestyle.waste",
        "s.lifestyle.eco_actions",
        "s.day_type",
    )


@query
def prediction_id(spark, folder):
    return activity(spark, folder).select(
        "record_id",
        conf.prediction_id(timestamp(), F.col("record_id")).alias("prediction_id"),
        conf.batch_prediction_id(timestamp(), F.col("record_id")).alias("batch_id"),
    )


@query
def batch_prediction_id(spark, folder):
    return activity(spark, folder).select(
        "record_id",
        conf.batch_prediction_id(timestamp(), F.col("record_id")).alias("batch_id"),
    )


@query
def score_distinct(spark, folder):
    # Coarse inputs repeat: distances and electricity in steps of ten.
    rows = activity(spark, folder).withColumns(
        {
            "distance_km": F.floor(F.col("distance_km") / 10) * 10.0,
            "electricity_kwh": F.floor(F.col("electricity_kwh") / 10) * 10.0,
        }
    )
    columns = ["transport_mode", "food_type", "distance_km", "electricity_kwh"]
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    scored = scoring.score_distinct(
        rows.drop(FOOTPRINT, LEVEL), scorer, columns
    )
    return rounded(scored.select("record_id", FOOTPRINT, LEVEL))


def _two_batches(spark, folder) -> list[tuple[DataFrame, DataFrame]]:
    """Rows of even and of odd days scored one after the other through one cache, and their figures."""
    rows = activity(spark, folder).withColumn("distance_km", F.floor(F.col("distance_km") / 10) * 10.0)
    columns = ["transport_mode", "food_type", "distance_km", "renewable_usage_pct"]
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    cache = scoring.ResultCache(spark, new_folder(spark, "result-cache"), "segments", columns)
    rows = rows.drop(FOOTPRINT, LEVEL)
    return [cache.score(rows.where(F.dayofmonth("activity_date") % 2 == day), scorer) for day in (0, 1)]


@query
def cached_scores(spark, folder):
    """Rows of both batches; the second one scores only inputs that the first has not met."""
    (first, _), (second, _) = _two_batches(spark, folder)
    both = first.unionByName(second)
    return rounded(both.select("record_id", FOOTPRINT, LEVEL))


@query
def cache_statistics(spark, folder):
    figures = [f.withColumn("batch", F.lit(i)) for i, (_, f) in enumerate(_two_batches(spark, folder))]
    return rounded(figures[0].unionByName(figures[1]))


@query
def repeat_statistics(spark, folder):
    rows = activity(spark, folder)
    return rounded(
        scoring.repeat_statistics(rows, ["day_type", "transport_mode", "food_type", "eco_actions"])
    )


def _both() -> list[Column]:
    return [F.col("linear_pred"), F.col("segment_mean")]


def _soft(row_level: str) -> dict[str, Column]:
    """Hard probabilities of a level: one for the level, zero elsewhere."""
    return {v: F.expr(f"if({row_level} = '{v}', 1.0D, 0.0D)") for v in LEVELS}


def _segment_soft() -> dict[str, Column]:
    return {v: F.col(f"p_{v.lower()}") for v in LEVELS}


@query
def vote_mean(spark, folder):
    return test_rows(spark, folder).select(
        "record_id", F.round(ensemble.vote_mean(_both()), 7).alias("prediction")
    )


@query
def vote_majority(spark, folder):
    mean_level = X.impact_level("mean_pred")
    likely = ensemble.most_likely(_segment_soft())
    rows = test_rows(spark, folder).withColumn("mean_pred", ensemble.vote_mean(_both()))
    return rows.select(
        "record_id",
        ensemble.vote_majority([F.col("linear_level"), F.col("segment_level"), likely]).alias(
            "three_votes"
        ),
        # Two voters tie whenever they differ.
        ensemble.vote_majority([F.col("linear_level"), mean_level]).alias("two_votes"),
    )


def _validation_scores(spark, folder) -> dict[str, Column]:
    """Each simple model's r2 on the test rows, found once."""
    names = ("linear_pred", "segment_mean")
    gap = {p: F.avg(F.pow(F.col(FOOTPRINT) - F.col(p), 2)) / F.var_pop(FOOTPRINT) for p in names}
    row = test_rows(spark, folder).agg(*[r6(1 - g).alias(p) for p, g in gap.items()]).first()
    return {p: F.lit(row[p]).cast("double") for p in names}


@query
def vote_weighted(spark, folder):
    w = _validation_scores(spark, folder)
    weights = [w["linear_pred"], w["segment_mean"]]
    return test_rows(spark, folder).select(
        "record_id",
        r6(ensemble.vote_weighted(_both(), weights)).alias("prediction"),
        r6(ensemble.vote_weighted(_both(), [w["linear_pred"], F.lit(None).cast("double")])).alias(
            "with_default_weight"
        ),
    )


@query
def vote_soft(spark, folder):
    pair = [_soft("linear_level"), _segment_soft()]
    mean = ensemble.vote_soft(pair)
    weighted = ensemble.vote_soft(pair, "weighted", [0.4, 0.8])
    return rounded(
        test_rows(spark, folder).select(
            "record_id",
            *[mean[v].alias(f"mean_{v.lower()}") for v in LEVELS],
            *[weighted[v].alias(f"weighted_{v.lower()}") for v in LEVELS],
            ensemble.most_likely(mean).alias("prediction"),
        )
    )


@query
def ensemble_predict(spark, folder):
    rows = stored(baseline.split_activity(activity(spark, folder)))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    encoder = stages.create_preprocessor().fit(train)
    members = [
        training.train(
            training.ModelConfig("regression", algorithm), train, test, encoder, measure=False
        )
        for algorithm in ("linear_regression", "random_forest")
    ]
    # The members' own predictions, the mean and the weighted vote come from one pass of each member.
    votes = ensemble.ModelEnsemble(members).with_votes(test, {"mean_vote": "voting", "weighted_vote": "weighted"})
    v0, v1 = F.col("member_0"), F.col("member_1")
    between = F.col("weighted_vote").between(F.least(v0, v1) - 1e-6, F.greatest(v0, v1) + 1e-6)
    return votes.select(
        "record_id",
        (F.abs(F.col("mean_vote") - (v0 + v1) / 2) < 1e-6).alias("mean_is_mean"),
        between.alias("weighted_is_between"),
    )


@query
def make_prediction(spark, folder):
    rows = activity(spark, folder)
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    scored = scoring.with_plausibility(
        scoring.score_batch(rows, scorer, None, timestamp(), "service")
    )
    return rounded(
        scored.select(
            "record_id",
            FOOTPRINT,
            LEVEL,
            "confidence",
            F.col("validation.is_valid").alias("is_plausible"),
            F.concat_ws("; ", "validation.warnings").alias("warnings"),
            "timestamp",
        )
    )


@query
def stream_score(spark, folder):
    train = train_rows(spark, folder)
    scorer = baseline.segment_scorer(train, store=True)
    stats = train.agg(
        F.avg(FOOTPRINT).alias("mean"),
        F.stddev_samp(FOOTPRINT).alias("std"),
        F.min(FOOTPRINT).alias("min"),
        F.max(FOOTPRINT).alias("max"),
    ).first().asDict()

    def score(events: DataFrame) -> DataFrame:
        return scoring.score_batch(from_events(events), scorer, stats, timestamp()).select(
            "record_id", FOOTPRINT, LEVEL, "confidence"
        )

    output = new_folder(spark, "stream-output")
    arriving = read_stream(spark, folder, EVENTS_SCHEMA, "parquet", "events.parquet")
    running = score_stream(arriving, score, output, new_folder(spark, "stream-checkpoint"))
    running.awaitTermination()
    return rounded(
        spark.read.schema(
            f"record_id bigint, {FOOTPRINT} double, {LEVEL} string, confidence double"
        ).parquet(output)
    )


def _replayed_stream(spark, folder) -> str:
    """All events arrive twice; the folder of the rows and counts."""
    scorer = baseline.segment_scorer(train_rows(spark, folder), store=True)

    def score(events: DataFrame) -> DataFrame:
        scored = scorer(from_events(events).drop(FOOTPRINT, LEVEL))
        return scored.select("record_id", F.round(FOOTPRINT, 6).alias(FOOTPRINT), LEVEL)

    def arriving() -> DataFrame:
        return read_stream(spark, folder, EVENTS_SCHEMA, "parquet", "events.parquet")

    records = arriving().unionByName(arriving()).withColumn("event_time", F.col("ts").cast("timestamp"))
    output = new_folder(spark, "stream-once")
    score_stream_once(records, score, output, "event_id", "event_time").awaitTermination()
    return output


@query
def stream_score_once(spark, folder):
    schema = f"record_id long, {FOOTPRINT} double, {LEVEL} string"
    return scored_once(spark, _replayed_stream(spark, folder), schema).drop("batch")


@query
def stream_level_counts(spark, folder):
    """Running counts after the last micro-batch with records of the level."""
    counts = running_counts(spark, _replayed_stream(spark, folder))
    return counts.groupBy(LEVEL).agg(F.max_by("total", "batch").alias("total"))


# --- Row rules ---------------------------------------------------------------


@query
def suggestions_core(spark, folder):
    return activity(spark, folder).select(
        "record_id", F.to_json(suggestions(LEVEL)).alias("suggestions")
    )


@query
def suggestions_service(spark, folder):
    return activity(spark, folder).select(
        "record_id", F.to_json(suggestions(LEVEL, "service")).alias("suggestions")
    )


def _with_shares(spark, folder, variant: str = "core") -> DataFrame:
    """Records with their contributions and ranked shares."""
    rows = activity(spark, folder)
    if variant == "core":
        return contrib.with_ranked_shares(contrib.with_contributions(rows))
    parts = rows.withColumn("contributions", contrib.service_contributions())
    return contrib.with_ranked_shares(parts, factors=contrib.SERVICE_FACTORS, places=None)


def _exploded(df: DataFrame, shares: Column, *extra: str) -> DataFrame:
    # A plain explode would first filter on the size of the array, and so
    # compute it twice.
    return (
        df.select("record_id", F.posexplode_outer(shares).alias("position", "s"))
        .where("position is not null")
        .selectExpr(
            "record_id", "position", "s.factor", "round(s.percentage, 6) as percentage", *extra
        )
    )


@query
def contributions(spark, folder):
    rows = contrib.with_contributions(activity(spark, folder))
    return rows.selectExpr("record_id", "inline_outer(contributions)")


@query
def contributions_service(spark, folder):
    rows = activity(spark, folder).withColumn("parts", contrib.service_contributions())
    return rounded(rows.selectExpr("record_id", "inline_outer(parts)"))


@query
def contribution_pct(spark, folder):
    return _exploded(_with_shares(spark, folder), F.col("shares"))


@query
def contribution_pct_service(spark, folder):
    rows = _with_shares(spark, folder, "service")
    return _exploded(rows, contrib.top_factors("shares", 5))


@query
def top_factors(spark, folder):
    return _exploded(_with_shares(spark, folder), contrib.top_factors("shares"))


@query
def key_factors(spark, folder):
    rows = _with_shares(spark, folder, "service")
    return _exploded(rows, contrib.key_factors("shares"), "s.description")


@query
def explain_text(spark, folder):
    text = explanation(FOOTPRINT, LEVEL, "shares").alias("explanation")
    return _with_shares(spark, folder).select("record_id", text)


@query
def explain_text_service(spark, folder):
    text = service_explanation(FOOTPRINT, LEVEL, "shares").alias("explanation")
    return _with_shares(spark, folder, "service").select("record_id", text)


@query
def plausibility_checks(spark, folder):
    # Raw records, so that impossible values show up, with a rough footprint and
    # a level that is wrong for some.
    rows = coerced(spark, folder).selectExpr(
        "record_id", "transport_mode", "distance_km", "electricity_kwh", "screen_time_hours",
        "waste_generated_kg",
        "renewable_usage_pct * 1.02D as renewable_usage_pct",
        "eco_actions - 1 as eco_actions",
        f"round(distance_km * 0.1D + electricity_kwh * 0.4D + eco_actions, 4) as {FOOTPRINT}",
    )
    level = f"if(record_id % 7 = 0, 'Low', {X.level_sql(FOOTPRINT)})"
    return (
        rows.withColumn(LEVEL, F.expr(level))
        .select("record_id", plausibility().alias("v"))
        .selectExpr(
            "record_id",
            "v.is_valid",
            "concat_ws('; ', v.warnings) as warnings",
            "concat_ws('; ', v.errors) as errors",
        )
    )


@query
def importance_topk(spark, folder):
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "random_forest", feature_engineering=False)
    fitted = training.train(config, train, measure=False)
    every, top = attribution.importance_frame(spark, fitted), attribution.importance_frame(spark, fitted, 10)
    # Importances add up to one, and the ten listed are the largest.
    rest = every.join(top.select("slot"), "slot", "left_anti")
    return every.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total")).withColumns(
        {
            "listed": top.agg(F.count(F.lit(1))).scalar(),
            "largest": top.agg(F.min("importance")).scalar() >= rest.agg(F.max("importance")).scalar(),
        }
    )


@query
def linear_attribution(spark, folder):
    # Fixed weights per unit of the numeric fields.
    weights = {
        "distance_km": contrib.DISTANCE_WEIGHT,
        "electricity_kwh": contrib.ENERGY_WEIGHT,
        "renewable_usage_pct": contrib.RENEWABLE_WEIGHT,
        "screen_time_hours": contrib.SCREEN_WEIGHT,
        "waste_generated_kg": contrib.WASTE_WEIGHT,
        "eco_actions": contrib.ECO_ACTION_WEIGHT,
    }
    rows = attribution.linear_attribution(
        activity(spark, folder), weights, train_rows(spark, folder)
    )
    return rounded(rows.select("record_id", *[f"attribution_{c}" for c in weights]))


@query
def sampled_attribution(spark, folder):
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "linear_regression", feature_engineering=False)
    fitted = training.train(config, train)
    encoded = fitted.encode(train)
    centres = attribution.kmeans_background(encoded)
    parts = attribution.sampled_attribution(encoded, "record_id", fitted, centres)
    # Shares add up to the prediction minus the background's mean prediction.
    weights, total = fitted.model.coefficients.toArray(), sum(n for _, n in centres)
    middle = sum(n * (float(weights @ c) + fitted.model.intercept) for c, n in centres) / total
    sums = parts.groupBy("record_id").agg(F.sum("attribution").alias("sum"), F.count(F.lit(1)).alias("features"))
    joined = sums.join(fitted.apply(encoded).select("record_id", f"{FOOTPRINT}_predicted"), "record_id")
    gap = F.abs(F.col("sum") + middle - F.col(f"{FOOTPRINT}_predicted"))
    return joined.select("record_id", "features", (gap < 1e-6).alias("adds_up"))


@query
def explain_sample(spark, folder):
    rows = activity(spark, folder)
    config = training.ModelConfig(
        "classification", "random_forest", feature_engineering=False
    )
    fitted = training.train(config, train_rows(spark, folder), measure=False)
    out = attribution.explain_sample(spark, rows, fitted)
    shares = F.map_values("feature_contributions")
    return out.select(
        "record_id",
        F.size(shares).alias("contributions"),
        (F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) <= 1 + 1e-6).alias("shares_of_one"),
        _sums_to_one(F.col("class_probabilities")).alias("sums_to_one"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _own_values(name: str, task: str, algorithm: str, parameters: dict) -> None:
    """Every record's Shapley values of a tree model: do they add up, and do records differ?"""

    def run(spark, folder):
        config = training.ModelConfig(task, algorithm, parameters, feature_engineering=False)
        fitted = training.train(config, train_rows(spark, folder), measure=False)
        out = attribution.explain_sample(spark, activity(spark, folder), fitted)
        gap = _sum(F.map_values("shap_values")) + F.col("expected_output") - F.col("explained_output")
        zero = F.forall(F.map_values("shap_values"), lambda v: v == 0)
        return out.select(
            "record_id", F.size("shap_values").alias("features"), (F.abs(gap) < 1e-6).alias("adds_up"), (~zero).alias("explained")
        )

    run.__name__ = name
    query(run)


_own_values("explain_forest", "regression", "random_forest", {"n_estimators": 50, "max_depth": 6})
_own_values("explain_boosting", "regression", "xgboost", {"n_estimators": 30, "max_depth": 4, "learning_rate": 0.1})
_own_values("explain_classes", "classification", "random_forest", {"n_estimators": 30, "max_depth": 5})


@query
def explain_stump(spark, folder):
    """One split by one field: a record's share is its group's mean label minus the mean of all."""
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "xgboost", {"n_estimators": 1, "max_depth": 1})
    encoder = stages.create_preprocessor([], ["day_type"], scale=False).fit(train)
    fitted = training.train(config, train, preprocessor=encoder)
    out = attribution.explain_sample(spark, activity(spark, folder), fitted)
    return out.select(
        "record_id",
        F.round(_sum(F.map_values("shap_values")), 5).alias("share"),
        F.round("expected_output", 5).alias("expected"),
    )


@query
def kernel_attribution(spark, folder):
    """Least-squares Shapley values of a boosted model against ten centres, and their error."""
    train = stored(train_rows(spark, folder))
    parameters = {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.3}
    config = training.ModelConfig("regression", "xgboost", parameters, feature_engineering=False)
    fitted = training.train(config, train)
    encoded = fitted.encode(train)
    centres = attribution.kmeans_background(encoded)
    out = fitted.apply(attribution.kernel_attribution(encoded, fitted, centres, budget=300))
    values, errors = F.get("shap_values", F.lit(0)), F.get("shap_errors", F.lit(0))
    gap = _sum(values) + F.get("base_values", F.lit(0)) - F.col(f"{FOOTPRINT}_predicted")
    # The error of the largest value is a small part of the values' spread.
    small = F.array_max(errors) < 0.1 * F.greatest(F.array_max(values) - F.array_min(values), F.lit(0.1))
    return out.select(
        "record_id", F.size(values).alias("features"), (F.abs(gap) < 1e-6).alias("adds_up"), small.alias("small_error")
    )


@query
def kernel_linear(spark, folder):
    """Of a linear model the least-squares values are exact: coefficient times the distance to the background."""
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh", "distance_km"], [], scale=False).fit(train)
    fitted = training.train(config, train, preprocessor=encoder)
    mean = train.agg(F.avg("electricity_kwh"), F.avg("distance_km")).first()
    out = attribution.kernel_attribution(fitted.encode(activity(spark, folder)), fitted, [(list(mean), 1)])
    values = F.get("shap_values", F.lit(0))
    return out.select("record_id", *[F.round(F.get(values, F.lit(i)), 4).alias(f"share_{n}") for i, n in enumerate(("electricity", "distance"))])


@query
def explain_linear(spark, folder):
    """Exact attributions of a linear model for every record."""
    train = train_rows(spark, folder)
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh"], [], scale=False).fit(train)
    fitted = training.train(config, train, preprocessor=encoder)
    out = attribution.explain_sample(spark, activity(spark, folder), fitted, train)
    return out.select(
        "record_id",
        F.round(f"{FOOTPRINT}_predicted", 5).alias("prediction"),
        F.round(F.get(F.map_values("feature_contributions"), F.lit(0)), 5).alias("electricity_share"),
    )


@query
def cross_validation(spark, folder):
    """Spark ML cross-validation of a linear model with one feature."""
    rows = activity(spark, folder)
    config = training.ModelConfig("regression", "linear_regression")
    encoder = stages.create_preprocessor(["electricity_kwh"], [], scale=False).fit(rows)
    fitted = training.train(config, rows, preprocessor=encoder, key="record_id")
    found = fitted.metrics
    scores = [(i, float(s), float(found["cv_mean"]), float(found["cv_std"])) for i, s in enumerate(found["cv_scores"])]
    frame = spark.createDataFrame(scores, "fold int, r2 double, cv_mean double, cv_std double")
    # Rows of each fold from the table itself.
    sizes = splits.contiguous_folds(rows, "record_id").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(frame), "fold").select(
        "fold", "n", *[F.round(c, 5).alias(c) for c in ("r2", "cv_mean", "cv_std")]
    )


@query
def linear_folds(spark, folder):
    """All folds of a linear model with two features from one pass of products."""
    rows = splits.contiguous_folds(activity(spark, folder), "record_id")
    encoder = stages.create_preprocessor(["electricity_kwh", "distance_km"], [], scale=False).fit(rows)
    encoded = training.with_label(encoder.transform(rows), "regression")
    scores = training.linear_fold_scores(encoded, 5)
    frame = spark.createDataFrame(list(enumerate(scores)), "fold int, r2 double")
    # Five rows.
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(frame), "fold").select("fold", "n", F.round("r2", 5).alias("r2"))


@query
def catalog_cross_validation(spark, folder):
    """Every named configuration cross-validated on five folds."""
    train = stored(train_rows(spark, folder))
    encoder = stages.create_preprocessor(engineer=True).fit(train)

    def validated(name: str) -> list[tuple]:
        found = training.train(training.create_config(name), train, None, encoder, key="record_id").metrics
        return [(name, i, float(s), float(found["cv_mean"]), float(found["cv_std"])) for i, s in enumerate(found["cv_scores"])]

    # Boosting runs many short jobs one after the other; three configurations at a time fill the cores.
    with ThreadPoolExecutor(3) as pool:
        scores = [row for rows in pool.map(validated, training.default_configs()) for row in rows]
    frame = spark.createDataFrame(scores, "name string, fold int, score double, cv_mean double, cv_std double")
    # The folds' own sizes and what guessing the commonest level would reach.
    guess = splits.stratified_folds(train, "record_id").groupBy("fold", LEVEL).agg(F.count(F.lit(1)).alias("n"))
    guess = guess.groupBy("fold").agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("guess"))
    least = F.when(F.col("name").endswith("_clf"), F.col("guess")).otherwise(F.lit(0.0))
    return frame.join(F.broadcast(guess), "fold").select(
        "name", "fold", F.col("score").between(least, F.lit(1.0)).alias("beats_guessing"),
        (F.abs(F.avg("score").over(Window.partitionBy("name")) - F.col("cv_mean")) < 1e-9).alias("mean_is_mean"),
    )


@query
def global_explanation(spark, folder):
    config = training.ModelConfig("regression", "random_forest", feature_engineering=False)
    fitted = training.train(config, train_rows(spark, folder))
    found = attribution.global_explanation(spark, fitted)
    importance = F.when(F.col("section") == "feature_importance", F.col("value"))
    return found.groupBy("section").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(importance), 6).alias("importance_total")
    )


def _formula(df: DataFrame) -> DataFrame:
    parts = " + ".join(contrib.raw_contributions().values())
    return df.withColumn(FOOTPRINT, F.expr(f"3.5D + {parts}"))


@query
def what_if(spark, folder):
    return rounded(attribution.what_if(activity(spark, folder), _formula))


# --- Evaluation and profiles -------------------------------------------------


@query
def regression_metrics(spark, folder):
    return rounded(
        evaluation.regression_metrics(test_rows(spark, folder), FOOTPRINT, "segment_mean")
    )


def _confusion(spark, folder) -> DataFrame:
    return evaluation.confusion_counts(test_rows(spark, folder), LEVEL, "linear_level")


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(test_rows(spark, folder), LEVEL, "linear_level")


@query
def classification_metrics(spark, folder):
    return rounded(evaluation.classification_metrics(_confusion(spark, folder)))


@query
def per_class_metrics(spark, folder):
    return rounded(evaluation.per_class_metrics(_confusion(spark, folder)).drop("hits"))


@query
def classification_report(spark, folder):
    return rounded(evaluation.classification_report(_confusion(spark, folder)))


def _with_probabilities(spark, folder) -> DataFrame:
    labels = F.array(*[F.lit(v) for v in LEVELS])
    return test_rows(spark, folder).withColumn(
        "probabilities", F.map_from_arrays(labels, _class_probabilities())
    )


@query
def roc_auc_by_class(spark, folder):
    return rounded(
        evaluation.rank_auc(_with_probabilities(spark, folder), LEVEL, "probabilities")
    )


@query
def roc_auc_ovr(spark, folder):
    return rounded(
        evaluation.roc_auc_ovr(_with_probabilities(spark, folder), LEVEL, "probabilities")
    )


@query
def compare_models(spark, folder):
    rows = baseline.long_predictions(activity(spark, folder)).where("split = 'test'")
    return rounded(evaluation.compare_regressors(rows))


@query
def compare_classifiers(spark, folder):
    labels = F.array(*[F.lit(v) for v in LEVELS])
    voters = [("linear", _soft("linear_level"), "linear_level"),
              ("segment", _segment_soft(), "segment_level")]
    rows = test_rows(spark, folder).select(
        F.col(LEVEL).alias("level"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("algorithm"),
                        F.col(level).alias("prediction"),
                        F.map_from_arrays(labels, F.array(*p.values())).alias("probabilities"),
                    )
                    for name, p, level in voters
                ]
            )
        ),
    )
    return rounded(evaluation.compare_classifiers(rows, "level"))


def _scored(spark, folder) -> DataFrame:
    """A stored scored batch, as reports over it read it more than once."""
    scorer = baseline.segment_scorer(train_rows(spark, folder))
    stats = profile.target_stats(train_rows(spark, folder))
    scored = scoring.score_batch(coerced(spark, folder), scorer, stats, timestamp())
    return materialise(scored.select(FOOTPRINT, LEVEL, "confidence", "error"), "scored")


@query
def analyze_predictions(spark, folder):
    return rounded(profile.analyze_predictions(_scored(spark, folder)))


@query
def error_types(spark, folder):
    # Messages of all three kinds.
    errors = scoring.quarantine(coerced(spark, folder)).withColumn(
        "error",
        F.when(F.col("record_id") % 83 == 0, "Model best_regression not found")
        .when(F.col("record_id") % 89 == 0, "Unexpected end of input")
        .otherwise(F.col("error")),
    )
    return profile.error_types(errors)


@query
def analyze_batch(spark, folder):
    return rounded(profile.analyze_batch(_scored(spark, folder)))


@query
def footprint_correlations(spark, folder):
    return rounded(profile.footprint_correlations(coerced(spark, folder, [FOOTPRINT])))


@query
def correlation_matrix(spark, folder):
    return rounded(profile.correlation_matrix(activity(spark, folder)))


@query
def null_counts(spark, folder):
    return profile.null_counts(coerced(spark, folder), FEATURES)


@query
def describe(spark, folder):
    return rounded(profile.describe(coerced(spark, folder), NUMERIC_FEATURES))


@query
def value_counts(spark, folder):
    return profile.value_counts(activity(spark, folder))


@query
def histogram(spark, folder):
    return rounded(profile.histogram(activity(spark, folder)))


@query
def box_stats(spark, folder):
    return rounded(profile.box_stats(activity(spark, folder)))


@query
def segment_means(spark, folder):
    return rounded(profile.segment_means(activity(spark, folder)))


@query
def scatter_grid(spark, folder):
    return profile.scatter_grid(activity(spark, folder))


@query
def scatter_sample(spark, folder):
    return profile.scatter_sample(activity(spark, folder), "record_id", 100)


@query
def dataset_profile(spark, folder):
    return rounded(profile.dataset_profile(activity(spark, folder)))


@query
def prediction_statistics(spark, folder):
    return rounded(profile.prediction_statistics(activity(spark, folder)))


@query
def metrics_summary(spark, folder):
    rows = baseline.long_predictions(activity(spark, folder))
    scores = evaluation.regression_metrics(
        rows, "label", "prediction", ["algorithm", "split"]
    ).select(
        F.lit("regression").alias("task"),
        F.col("algorithm").alias("model"),
        F.concat("split", F.lit("_r2")).alias("metric"),
        F.col("r2").alias("value"),
    )
    return rounded(evaluation.leaderboard(scores))


@query
def impact_by_mode(spark, folder):
    """Levels of valid records by transport mode: the flagship report."""
    rows = coerced(spark, folder, [FOOTPRINT]).withColumnRenamed(FOOTPRINT, "measured_kg")
    good = scoring.quarantine(rows).where("is_valid")
    return rounded(
        good.groupBy("transport_mode", X.impact_level("measured_kg").alias(LEVEL)).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("measured_kg").alias("mean_footprint"),
            F.avg(F.col("electricity_kwh")).alias("mean_electricity"),
        )
    )
