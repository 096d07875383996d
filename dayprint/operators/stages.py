"""Spark ML stages for feature engineering and encoding."""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from dayprint.constants import CATEGORICAL_FEATURES, FOOTPRINT, LEVEL, LEVELS, NUMERIC_FEATURES
from dayprint.constants import HIGH_THRESHOLD, LOW_THRESHOLD
from dayprint.functions import features as X
from dayprint.operators.order_statistics import exact_quantiles, long_numeric

FILL_CATEGORY = "missing"


def max_transport_score(df: DataFrame) -> Column:
    """Largest transport score of a frame, as a scalar subquery."""
    return df.agg(F.max(X.transport_impact_score())).scalar()


def engineer_features(
    df: DataFrame, max_score: Column | None = None, create_interactions: bool = True
) -> DataFrame:
    """Add the engineered columns.

    ``max_score`` is the largest transport score of the training data. Without
    it the frame's own largest score is used.
    """
    if max_score is None:
        max_score = max_transport_score(df)
    added = {
        "transport_impact_score": X.transport_impact_score(),
        "energy_efficiency": X.energy_efficiency(),
        "waste_per_activity": X.waste_per_activity(),
        "sustainability_score": X.sustainability_score(max_score),
    }
    if create_interactions:
        added["transport_electricity_interaction"] = X.transport_electricity_interaction()
        added["renewable_waste_interaction"] = X.renewable_waste_interaction()
    added["is_weekend"] = X.is_weekend()
    return df.withColumns(added)


class _EngineerParams(Params):
    createInteractions = Param(
        Params._dummy(), "createInteractions", "add products", TypeConverters.toBoolean
    )
    maxScore = Param(
        Params._dummy(), "maxScore", "largest training score", TypeConverters.toFloat
    )

    def __init__(self):
        super().__init__()
        self._setDefault(createInteractions=True)


class FeatureEngineer(Estimator, _EngineerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the largest transport score, then adds the engineered columns."""

    @keyword_only
    def __init__(self, *, createInteractions=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        score = dataset.agg(F.max(X.transport_impact_score())).first()[0]
        return FeatureEngineerModel(
            createInteractions=self.getOrDefault("createInteractions"),
            maxScore=float(score or 0.0),
        )


class FeatureEngineerModel(Model, _EngineerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, createInteractions=True, maxScore=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return engineer_features(
            dataset,
            F.lit(self.getOrDefault("maxScore")),
            self.getOrDefault("createInteractions"),
        )


class ImpactLeveller(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the impact level of a footprint; frames without one pass unchanged."""

    low = Param(Params._dummy(), "low", "below is Low", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "above is High", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, low=LOW_THRESHOLD, high=HIGH_THRESHOLD):
        super().__init__()
        self._setDefault(low=LOW_THRESHOLD, high=HIGH_THRESHOLD)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        if FOOTPRINT not in dataset.columns:
            return dataset
        return dataset.withColumn(
            LEVEL,
            X.impact_level(FOOTPRINT, self.getOrDefault("low"), self.getOrDefault("high")),
        )


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians, one row per column: ``variable``, ``median``."""
    return exact_quantiles(
        long_numeric(df, columns), ["variable"], "value", {"median": 0.5}
    ).select("variable", "median")


def impute_median(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Replace nulls by the column's median over the frame."""
    # One number per column.
    medians = {r["variable"]: r["median"] for r in exact_medians(df, columns).collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")) for c in columns}
    )


def impute_constant(df: DataFrame, columns: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    return df.fillna(FILL_CATEGORY, subset=columns)


def standard_scale(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    moments = df.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                for c in columns
            ]
        )
    ).scalar()

    def scaled(c: str) -> Column:
        std = moments[c]["std"]
        return (F.col(c) - moments[c]["mean"]) / F.when(std > 0, std).otherwise(1.0)

    return df.withColumns({c: scaled(c) for c in columns})


class _ColumnStats(Params):
    columns = Param(Params._dummy(), "columns", "columns", TypeConverters.toListString)


class NumericPreparer(Estimator, _ColumnStats, DefaultParamsReadable, DefaultParamsWritable):
    """Learns exact medians, then means and population deviations after filling."""

    @keyword_only
    def __init__(self, *, columns=NUMERIC_FEATURES):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        columns = self.getOrDefault("columns")
        found = {r["variable"]: r["median"] for r in exact_medians(dataset, columns).collect()}
        # A column without any value is filled with zero.
        medians = [float(found.get(c) or 0.0) for c in columns]
        filled = [
            F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c)
            for c, m in zip(columns, medians)
        ]
        row = (
            dataset.select(*filled)
            .agg(
                *[F.avg(c).alias(f"mean_{c}") for c in columns],
                *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
            )
            .first()
        )
        return NumericPreparerModel(
            columns=columns,
            medians=medians,
            means=[row[f"mean_{c}"] for c in columns],
            deviations=[row[f"std_{c}"] or 1.0 for c in columns],
        )


class NumericPreparerModel(Model, _ColumnStats, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, medians=None, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        stats = zip(
            self.getOrDefault("columns"),
            self.getOrDefault("medians"),
            self.getOrDefault("means"),
            self.getOrDefault("deviations"),
        )
        return dataset.withColumns(
            {
                f"{c}_scaled": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / dev
                for c, m, mean, dev in stats
            }
        )


class CategoryFiller(Transformer, _ColumnStats, DefaultParamsReadable, DefaultParamsWritable):
    """Copies categorical columns with nulls replaced by ``missing``."""

    @keyword_only
    def __init__(self, *, columns=CATEGORICAL_FEATURES):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumns(
            {
                f"{c}_filled": F.coalesce(F.col(c), F.lit(FILL_CATEGORY))
                for c in self.getOrDefault("columns")
            }
        )


def create_preprocessor(
    numeric: list[str] = NUMERIC_FEATURES,
    categorical: list[str] = CATEGORICAL_FEATURES,
    engineer: bool = False,
    interactions: bool = True,
    scale: bool = True,
) -> Pipeline:
    """Numeric columns first, then one slot per category in alphabetical order.

    Categories unseen while fitting get zeros. With ``engineer`` the engineered
    columns are added to the numeric ones.
    """
    stages: list = []
    numeric = list(numeric)
    if engineer:
        stages.append(FeatureEngineer(createInteractions=interactions))
        numeric += ["transport_impact_score", "energy_efficiency", "waste_per_activity",
                    "sustainability_score"]
        if interactions:
            numeric += ["transport_electricity_interaction", "renewable_waste_interaction"]
        numeric.append("is_weekend")
    if numeric:
        stages.append(NumericPreparer(columns=numeric) if scale else NumericFiller(columns=numeric))
    slots = [f"{c}_scaled" for c in numeric]
    if categorical:
        stages += [
            CategoryFiller(columns=list(categorical)),
            StringIndexer(
                inputCols=[f"{c}_filled" for c in categorical],
                outputCols=[f"{c}_index" for c in categorical],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in categorical],
                outputCols=[f"{c}_vector" for c in categorical],
                # The dropped slot is the one for unseen categories.
                dropLast=True,
            ),
        ]
        slots += [f"{c}_vector" for c in categorical]
    stages.append(VectorAssembler(inputCols=slots, outputCol="features"))
    return Pipeline(stages=stages)


class NumericFiller(NumericPreparer):
    """Fills medians but keeps the scale."""

    def _fit(self, dataset):
        model = super()._fit(dataset)
        n = len(self.getOrDefault("columns"))
        return model._set(means=[0.0] * n, deviations=[1.0] * n)


def feature_names(preprocessor: PipelineModel) -> list[str]:
    """Names of the vector slots, such as ``transport_mode_Car``."""
    if not isinstance(preprocessor, PipelineModel):
        raise ValueError("Preprocessor not loaded: fit or load it first")
    names: list[str] = []
    for stage in preprocessor.stages:
        if isinstance(stage, NumericPreparerModel):
            names += stage.getOrDefault("columns")
        if isinstance(stage, StringIndexerModel):
            for column, labels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{column.removesuffix('_filled')}_{label}" for label in labels]
    return names


def transform_with_names(
    preprocessor: PipelineModel, df: DataFrame, keep: list[str] = []
) -> DataFrame:
    """Encoded matrix as one named double column per slot."""
    from pyspark.ml.functions import vector_to_array

    names = feature_names(preprocessor)
    slots = preprocessor.transform(df).select(*keep, vector_to_array("features").alias("slots"))
    return slots.select(*keep, *[F.expr(f"slots[{i}] as `{n}`") for i, n in enumerate(names)])


def level_index(level: Column) -> Column:
    """Class number of a level: Low 0, Medium 1, High 2."""
    numbers = F.create_map(*[F.lit(x) for i, v in enumerate(LEVELS) for x in (v, float(i))])
    return numbers[level]


def index_level(index: Column) -> Column:
    """Level of a class number; an unknown number counts as Medium."""
    level = F
    for i, name in enumerate(LEVELS):
        level = level.when(index == i, name)
    return level.otherwise("Medium")
