"""Model catalogue and training jobs on Spark ML."""

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from dayprint.constants import FOOTPRINT, LEVEL, LEVELS
from dayprint.operators.boosting import boosted, fit_boosted
from dayprint.operators.calibration import out_of_fold_margins, platt_scaling, scaled_probabilities
from dayprint.operators.evaluation import (
    classification_metrics,
    classification_report,
    confusion_counts,
    regression_metrics,
)
from dayprint.operators.kernel_features import FourierFeatures
from dayprint.operators.splits import contiguous_folds, stratified_folds
from dayprint.operators.spread import alike_together, spread, spread_for_fit, stored
from dayprint.operators.stages import create_preprocessor, index_level, level_index

REGRESSION = (
    "random_forest", "linear_regression", "xgboost", "lightgbm", "catboost", "svr",
)
CLASSIFICATION = (
    "random_forest", "logistic_regression", "xgboost", "lightgbm", "catboost", "svc",
)
TRAIN_ALL = ("random_forest", "xgboost", "lightgbm", "catboost")
# Spark's trees go no deeper than this; deeper settings are refused.
MAX_DEPTH = 30
# A forest without a depth of its own: Spark grows all nodes of a level at once,
# so a level's statistics double with each level; this depth can be grown on
# large tables.
FOREST_DEPTH = 10
# Statistics of more nodes in one pass over the rows. The rows' nodes are kept in
# memory; a copy of them (4 bytes a row and tree) on disk would save little of
# the few passes.
GROWING = {"maxMemoryInMB": 1024, "cacheNodeIds": True, "checkpointInterval": -1}


@dataclass(frozen=True)
class ModelConfig:
    model_type: str
    algorithm: str
    hyperparameters: dict = field(default_factory=dict)
    feature_engineering: bool = True
    scale_features: bool = True
    use_cross_validation: bool = True
    cv_folds: int = 5
    random_state: int = 42

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> "ModelConfig":
        return cls(**values)


def default_configs() -> dict[str, ModelConfig]:
    # Hyperparameters of the named configurations; the forests'
    # published depth of 20 is FOREST_DEPTH here.
    families = {
        "random_forest": {"n_estimators": 100, "max_depth": FOREST_DEPTH, "min_samples_split": 5},
        "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
        "lightgbm": {"n_estimators": 100, "num_leaves": 31, "learning_rate": 0.1},
    }
    return {
        f"{family}_{suffix}": ModelConfig(task, family, dict(params))
        for task, suffix in (("regression", "reg"), ("classification", "clf"))
        for family, params in families.items()
    }


def create_config(name: str, overrides: dict | None = None) -> ModelConfig:
    """A named configuration; hyperparameters in ``overrides`` are merged in."""
    configs = default_configs()
    if name not in configs:
        raise ValueError(f"Unknown model: {name}. Available: {list(configs)}")
    config = configs[name]
    overrides = dict(overrides or {})
    merged = {**config.hyperparameters, **overrides.pop("hyperparameters", {})}
    return replace(config, hyperparameters=merged, **overrides)


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The named configurations as a table, one row per hyperparameter."""
    rows = [
        (name, c.model_type, c.algorithm, key, float(value))
        for name, c in default_configs().items()
        for key, value in c.hyperparameters.items()
    ]
    return spark.createDataFrame(
        rows,
        "name string, model_type string, algorithm string, hyperparameter string, value double",
    )


def _tree_depth(params: dict, default: int) -> int:
    if "num_leaves" in params:
        # A tree of this depth has at least as many leaves.
        depth = math.ceil(math.log2(params["num_leaves"]))
    else:
        depth = int(params.get("max_depth", params.get("depth", default)))
    if depth > MAX_DEPTH:
        raise ValueError(f"Trees of depth {depth} are not supported; {MAX_DEPTH} at most")
    return depth


def _kernel(params: dict, features: str, seed: int) -> tuple[list, str]:
    """The stages before a linear solver, and the column that they fill."""
    kernel = params.get("kernel", "rbf")
    if kernel == "linear":
        return [], features
    if kernel != "rbf":
        raise ValueError(f"Unknown kernel: {kernel}")
    gamma = params.get("gamma", "scale")
    stage = FourierFeatures(
        inputCol=features, components=int(params.get("components", 256)),
        gamma=0.0 if gamma == "scale" else float(gamma), seed=seed,
    )
    return [stage], stage.getOrDefault("outputCol")


def build_estimator(config: ModelConfig, features: str = "features", label: str = "label"):
    """The Spark ML estimator of a configuration.

    Boosting families share Spark's gradient-boosted trees and differ in their
    presets. Kernel machines are linear solvers (Huber loss, support vectors)
    behind random Fourier features; ``kernel="linear"`` leaves the features out.
    """
    params = dict(config.hyperparameters)
    algorithm = config.algorithm.lower()
    common = {"featuresCol": features, "labelCol": label}
    trees = int(params.get("n_estimators", params.get("iterations", 100)))
    forest = {
        "numTrees": trees,
        "maxDepth": _tree_depth(params, FOREST_DEPTH),
        # The nearest setting to a smallest splittable node.
        "minInstancesPerNode": max(1, int(params.get("min_samples_split", 2)) // 2),
        "seed": config.random_state,
    }
    boosting = {
        "maxIter": trees,
        "maxDepth": _tree_depth(
            params, {"xgboost": 6, "lightgbm": 5, "catboost": 6}.get(algorithm, 6)
        ),
        "stepSize": float(
            params.get("learning_rate", {"xgboost": 0.3, "catboost": 0.03}.get(algorithm, 0.1))
        ),
        "seed": config.random_state,
    }
    # The classes' binary models are independent jobs.
    one_vs_rest = {"parallelism": len(LEVELS)}
    if config.model_type == "regression":
        if algorithm == "random_forest":
            # Every split looks at all features, as is usual for regression.
            return RandomForestRegressor(
                **common, **forest, **GROWING, featureSubsetStrategy="all"
            )
        if algorithm == "linear_regression":
            return LinearRegression(**common, solver="normal")
        if algorithm in ("xgboost", "lightgbm", "catboost"):
            return GBTRegressor(**common, **boosting)
        if algorithm == "svr":
            front, columns = _kernel(params, features, config.random_state)
            solver = LinearRegression(
                featuresCol=columns, labelCol=label, loss="huber",
                epsilon=float(params.get("epsilon", 1.35)), maxIter=100,
                # A wide map needs a little regularisation.
                regParam=1e-4 / float(params.get("C", 1.0)) if front else 0.0,
            )
            return Pipeline(stages=[*front, solver]) if front else solver
        raise ValueError(f"Unknown regression algorithm: {algorithm}")
    if config.model_type == "classification":
        if algorithm == "random_forest":
            return RandomForestClassifier(**common, **forest, **GROWING)
        if algorithm == "logistic_regression":
            return LogisticRegression(
                **common, family="multinomial", maxIter=int(params.get("max_iter", 1000)),
                regParam=0.0,
            )
        if algorithm in ("xgboost", "lightgbm", "catboost"):
            return OneVsRest(classifier=GBTClassifier(**boosting), **common, **one_vs_rest)
        if algorithm == "svc":
            # A little regularisation keeps the solver stable on separable classes.
            penalty = 0.01 / float(params.get("C", 1.0))
            front, columns = _kernel(params, features, config.random_state)
            if front:
                penalty /= 100
            svm = LinearSVC(maxIter=int(params.get("max_iter", 50)), regParam=penalty)
            solver = OneVsRest(classifier=svm, featuresCol=columns, labelCol=label, **one_vs_rest)
            return Pipeline(stages=[*front, solver]) if front else solver
        raise ValueError(f"Unknown classification algorithm: {algorithm}")
    raise ValueError(f"Unknown model type: {config.model_type}")


def with_label(df: DataFrame, model_type: str) -> DataFrame:
    label = F.col(FOOTPRINT) if model_type == "regression" else level_index(F.col(LEVEL))
    return df.withColumn("label", label)


def class_probabilities(
    model, raw: str = "rawPrediction", probability: str = "probability", calibration: list | None = None
):
    """Array of class probabilities of a prediction.

    One-vs-rest models give margins only. Those of boosted trees are turned
    into probabilities per class and scaled to sum to one; those of support
    vectors go through the curves of ``calibration`` (null without them).
    """
    from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel

    if calibration:
        return scaled_probabilities(vector_to_array(raw), calibration)
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if not isinstance(model, OneVsRestModel):
        return vector_to_array(probability)
    if not isinstance(model.models[0], GBTClassificationModel):
        return F.lit(None).cast("array<double>")
    odds = F.transform(
        vector_to_array(raw), lambda m: 1 / (1 + F.exp(-2 * m))
    )
    return F.transform(
        odds, lambda p: p / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    )


@dataclass
class TrainedModel:
    """A fitted preprocessor and model with its settings and metrics."""

    config: ModelConfig
    preprocessor: PipelineModel
    model: object
    metrics: dict = field(default_factory=dict)
    # (slope, intercept) of each class's probability over its margin.
    calibration: list | None = None

    @property
    def name(self) -> str:
        return f"{self.config.model_type}_{self.config.algorithm}"

    def encode(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("Model must be trained before making predictions")
        return self.preprocessor.transform(df)

    def apply(self, encoded: DataFrame) -> DataFrame:
        """Predictions on encoded rows, without the encoder's helper columns."""
        out = self.model.transform(encoded)
        if self.config.model_type == "regression":
            return out.withColumnRenamed("prediction", f"{FOOTPRINT}_predicted")
        return out.withColumns(
            {
                "class_probabilities": class_probabilities(self.model, calibration=self.calibration),
                f"{LEVEL}_predicted": index_level(F.col("prediction")),
            }
        ).drop("prediction")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``class_probabilities`` added; classification only."""
        if self.config.model_type != "classification":
            raise ValueError("predict_proba is only available for classification models")
        return self.predict(df)

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` on all cores; a linear model is cheaper than the shuffle and gets it as it is."""
        # Asked of the class: a multinomial model's own `coefficients` raise.
        return df if hasattr(type(self.model), "coefficients") else spread(df)

    def ordered(self, encoded: DataFrame) -> DataFrame:
        """Encoded rows in the order that suits the model; a forest is much larger than a processor's cache."""
        return alike_together(encoded) if self.config.algorithm.lower() == "random_forest" else encoded

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction (and ``class_probabilities``) added."""
        out = self.apply(self.ordered(self.encode(self.dealt(df))))
        added = (
            [f"{FOOTPRINT}_predicted"]
            if self.config.model_type == "regression"
            else [f"{LEVEL}_predicted", "class_probabilities"]
        )
        return out.select(*df.columns, *added)


def _score(config: ModelConfig, predicted: DataFrame) -> dict:
    if config.model_type == "regression":
        row = regression_metrics(predicted, FOOTPRINT, f"{FOOTPRINT}_predicted").first()
        return {"rmse": row["rmse"], "r2": row["r2"]}
    confusion = confusion_counts(predicted, LEVEL, f"{LEVEL}_predicted")
    return {"accuracy": classification_metrics(confusion).first()["accuracy"]}


def fit_model(estimator, encoded: DataFrame):
    """The estimator's model; boosted trees of all classes grow together."""
    return fit_boosted(encoded, [estimator])[0] if boosted(estimator) else estimator.fit(encoded)


def _fit_with_folds(config: ModelConfig, encoded: DataFrame, fold: str = "fold") -> tuple[object, list]:
    """Boosted models of all rows and without each fold, grown together."""
    _whole_folds(config, encoded, fold)
    estimators = [build_estimator(config)] * (config.cv_folds + 1)
    model, *of_folds = fit_boosted(encoded, estimators, [None, *range(config.cv_folds)], fold)
    return model, of_folds


def _whole_folds(config: ModelConfig, encoded: DataFrame, fold: str) -> None:
    outside = encoded.where(F.coalesce(~F.col(fold).between(0, config.cv_folds - 1), F.lit(True)))
    if outside.limit(1).count():
        raise ValueError("Rows outside all folds would be left out of cross-validation")


def cross_validate(
    config: ModelConfig,
    preprocessor: PipelineModel,
    encoded: DataFrame,
    fold: str = "fold",
    parallelism: int = 2,
    models: list | None = None,
) -> dict:
    """Score of each fold with a model of the other folds; population deviation.

    Every row must be in one of the folds; ``parallelism`` folds run at a time.
    ``models`` are the folds' models if they are fitted already.
    """
    _whole_folds(config, encoded, fold)
    metric = "r2" if config.model_type == "regression" else "accuracy"
    if (config.model_type, config.algorithm) == ("regression", "linear_regression"):
        return _summary(linear_fold_scores(encoded, config.cv_folds, fold))
    estimator = build_estimator(config)
    if models is None and boosted(estimator):
        models = fit_boosted(encoded, [estimator] * config.cv_folds, list(range(config.cv_folds)), fold)

    def one(i: int) -> float:
        model = models[i] if models else estimator.fit(encoded.where(F.col(fold) != i))
        held = TrainedModel(config, preprocessor, model).apply(encoded.where(F.col(fold) == i))
        return _score(config, held)[metric]

    with ThreadPoolExecutor(parallelism) as pool:
        return _summary(list(pool.map(one, range(config.cv_folds))))


def linear_fold_scores(encoded: DataFrame, folds: int, fold: str = "fold") -> list[float]:
    """r2 of each fold under least squares on the other folds, from one pass over the rows.

    Every fold's products of (1, x, label) are added up by Spark; the fit without
    a fold is solved from the sum of all products less the fold's own, and the
    fold's error follows from its products too. Rows are shifted by their mean
    first, so that large values lose no digits.
    """
    rows = encoded.where("label is not null").select(F.col(fold).cast("int").alias("fold"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    width = rows.select(F.max(F.size("x"))).first()[0]
    if not width:
        return [float("nan")] * folds
    means = rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(width)], F.avg("y")).first()
    shift, size = np.array(means, float), width + 2

    def products(batches):
        total = np.zeros((folds, size, size))
        for batch in batches:
            at = batch.column("fold").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = np.column_stack([np.ones(len(at)), x - shift[:-1], batch.column("y").to_numpy() - shift[-1]])
            for k in np.unique(at):
                mine = z[at == k]
                total[k] += mine.T @ mine
        where = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.reshape(-1))], ["at", "value"])

    # folds * (slots + 2)^2 numbers, whatever the rows
    sums = rows.mapInArrow(products, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros(folds * size * size)
    for r in sums:
        gram[r["at"]] = r["value"]
    gram = gram.reshape(folds, size, size)
    whole = gram.sum(0)
    scores = []
    for held in gram:
        fit = whole - held
        beta = np.append(-np.linalg.pinv(fit[:-1, :-1], rcond=1e-11, hermitian=True) @ fit[:-1, -1], 1.0)
        spread = held[-1, -1] - held[0, -1] ** 2 / held[0, 0] if held[0, 0] else 0.0
        scores.append(float(1 - beta @ held @ beta / spread) if spread > 0 else float("nan"))
    return scores


def _summary(scores: list[float]) -> dict:
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {"cv_mean": mean, "cv_std": spread, "cv_scores": scores}


def _calibration(config: ModelConfig, encoded: DataFrame) -> list | None:
    """Probability curves of support vectors; other models have probabilities of their own."""
    if (config.model_type, config.algorithm.lower()) != ("classification", "svc"):
        return None
    if not config.hyperparameters.get("probability", True):
        return None
    return platt_scaling(out_of_fold_margins(build_estimator(config), encoded), len(LEVELS))


def train(
    config: ModelConfig,
    train_df: DataFrame,
    validation_df: DataFrame | None = None,
    preprocessor: PipelineModel | None = None,
    key: str | None = None,
    measure: bool = True,
) -> TrainedModel:
    """Fit one configuration and measure it on train and validation rows.

    ``key`` orders the rows into cross-validation folds and must be unique;
    without it cross-validation is left out. ``measure=False`` leaves out the
    scores on the training rows, which cost a prediction of all of them.
    """
    build_estimator(config)  # Unknown names fail before any data is read.
    if preprocessor is None:
        train_df = stored(train_df)
        preprocessor = create_preprocessor(
            engineer=config.feature_engineering, scale=config.scale_features
        ).fit(train_df)
    folded = train_df
    cross = config.use_cross_validation and key is not None
    if cross:
        split = contiguous_folds if config.model_type == "regression" else stratified_folds
        folded = split(train_df, key, folds=config.cv_folds)
    keep = [FOOTPRINT, LEVEL, "features"] + (["fold"] if cross else [])
    encoded = with_label(preprocessor.transform(folded).select(*keep), config.model_type)
    encoded = spread_for_fit(encoded, train_df.count())
    if config.algorithm.lower() == "random_forest":
        encoded = alike_together(encoded)
    encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator, of_folds = build_estimator(config), None
        if cross and boosted(estimator):
            model, of_folds = _fit_with_folds(config, encoded)
        metrics = cross_validate(config, preprocessor, encoded, models=of_folds) if cross else {}
        if of_folds is None:
            model = fit_model(estimator, encoded)
        fitted = TrainedModel(config, preprocessor, model, metrics)
        fitted.calibration = _calibration(config, encoded)
        if measure:
            metrics.update(
                {f"train_{k}": v for k, v in _score(config, fitted.apply(encoded)).items()}
            )
    finally:
        encoded.unpersist()
    if validation_df is not None:
        predicted = fitted.predict(validation_df)
        metrics.update({f"val_{k}": v for k, v in _score(config, predicted).items()})
        if config.model_type == "classification":
            confusion = confusion_counts(predicted, LEVEL, f"{LEVEL}_predicted")
            metrics["val_report"] = [
                r.asDict() for r in classification_report(confusion).collect()
            ]
    return fitted


def train_all(
    train_df: DataFrame,
    algorithms: tuple[str, ...] = TRAIN_ALL,
    tasks: tuple[str, ...] = ("regression", "classification"),
    hyperparameters: dict | None = None,
    engineer: bool = False,
    parallelism: int = 2,
) -> dict[str, TrainedModel]:
    """Every algorithm for both tasks on one shared preprocessing.

    The rows are encoded once and kept on the executors; the fits are separate
    Spark jobs that share the cluster, but boosted trees of one task, which grow
    together.
    """
    configs = [
        ModelConfig(task, a, dict(hyperparameters or {}), feature_engineering=engineer)
        for task in tasks
        for a in algorithms
    ]
    for config in configs:
        build_estimator(config)
    train_df = stored(train_df)
    preprocessor = create_preprocessor(engineer=engineer).fit(train_df)
    encoded = preprocessor.transform(train_df).select(FOOTPRINT, LEVEL, "features")
    encoded = spread_for_fit(encoded, train_df.count())
    if "random_forest" in algorithms:
        encoded = alike_together(encoded)
    encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)

    def fit(some: list[ModelConfig]) -> list[TrainedModel]:
        labelled = with_label(encoded, some[0].model_type)
        estimators = [build_estimator(c) for c in some]
        models = fit_boosted(labelled, estimators) if boosted(estimators[0]) else [e.fit(labelled) for e in estimators]
        return [TrainedModel(c, preprocessor, m, calibration=_calibration(c, labelled)) for c, m in zip(some, models)]

    together: dict[tuple, list[ModelConfig]] = {}
    for c in configs:
        together.setdefault((c.model_type, boosted(build_estimator(c)) or c.algorithm), []).append(c)
    try:
        # The longest first: boosting waits for the scheduler while a forest fills the cores.
        groups = sorted(together.values(), key=lambda some: -len(some))
        with ThreadPoolExecutor(parallelism) as pool:
            fitted = {m.name: m for some in pool.map(fit, groups) for m in some}
    finally:
        encoded.unpersist()
    return {f"{c.model_type}_{c.algorithm}": fitted[f"{c.model_type}_{c.algorithm}"] for c in configs}


def ml_scorer(regressor: TrainedModel, classifier: TrainedModel):
    """Scorer for ``score_batch`` from a regression and a classification model."""

    def score(df: DataFrame) -> DataFrame:
        if regressor.preprocessor is classifier.preprocessor:
            # Encoded once; both models read the same features.
            first = regressor.apply(regressor.ordered(regressor.encode(regressor.dealt(df)))).drop("rawPrediction")
            out = classifier.apply(first).select(
                *df.columns, f"{FOOTPRINT}_predicted", f"{LEVEL}_predicted", "class_probabilities"
            )
        else:
            out = classifier.predict(regressor.predict(df))
        return out.withColumnsRenamed(
            {f"{FOOTPRINT}_predicted": FOOTPRINT, f"{LEVEL}_predicted": LEVEL}
        )

    return score


def evaluate_all(models: dict[str, TrainedModel], test_df: DataFrame) -> DataFrame:
    """Tidy test metrics (task, model, metric, value) of every model.

    The rows are read and encoded once for each preprocessor; all its models add
    their prediction to the same rows, and one aggregation per task follows.
    """
    frames = []
    for preprocessor in {id(m.preprocessor): m.preprocessor for m in models.values()}.values():
        mine = [m for m in models.values() if m.preprocessor is preprocessor]
        keep = [FOOTPRINT, LEVEL, "features"]
        rows = preprocessor.transform(spread(test_df)).select(*keep)
        if any(m.config.algorithm == "random_forest" for m in mine):
            rows = alike_together(rows)
        for i, m in enumerate(mine):
            found = FOOTPRINT if m.config.model_type == "regression" else LEVEL
            rows = m.apply(rows).withColumnRenamed(f"{found}_predicted", f"of_{i}")
            keep.append(f"of_{i}")
            rows = rows.select(*keep)
        for task in {m.config.model_type for m in mine}:
            votes = [
                F.struct(F.lit(m.config.algorithm).alias("model"), F.col(f"of_{i}").alias("prediction"))
                for i, m in enumerate(mine)
                if m.config.model_type == task
            ]
            long = rows.select(FOOTPRINT, LEVEL, F.inline(F.array(*votes)))
            if task == "regression":
                wide = regression_metrics(long, FOOTPRINT, "prediction", ["model"]).select("model", "mse", "rmse", "r2")
            else:
                cells = confusion_counts(long, LEVEL, "prediction", ["model"])
                wide = classification_metrics(cells, ["model"])
            names = [c for c in wide.columns if c != "model"]
            tidy = wide.unpivot(["model"], names, "metric", "value")
            frames.append(tidy.select(F.lit(task).alias("task"), "model", "metric", "value"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
