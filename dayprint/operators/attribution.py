"""Importances and attributions of fitted models, and what-if scenarios."""

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayprint.constants import FEATURES, FOOTPRINT, LEVEL, LEVELS
from dayprint.operators.kernel_shapley import BLOCK_ROWS, KernelExplainer, kernel_columns, outputs_of
from dayprint.operators.spread import spread
from dayprint.operators.stages import feature_names
from dayprint.operators.tree_tables import shapley_column, tree_ensemble


def importance_frame(spark: SparkSession, trained, k: int | None = None) -> DataFrame:
    """Feature importances by name, largest first; needs a tree model."""
    names = feature_names(trained.preprocessor)
    model = trained.model
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        # One-vs-rest: mean importance over the classes' models.
        per_class = [m.featureImportances.toArray() for m in model.models]
        values = sum(per_class) / len(per_class)
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]
    frame = spark.createDataFrame(rows, "slot int, feature string, importance double").orderBy(
        F.desc("importance"), "slot"
    )
    return frame if k is None else frame.limit(k)


def linear_attribution(
    df: DataFrame, weights: dict[str, float], background: DataFrame | None = None
) -> DataFrame:
    """Exact additive attributions of a linear model: w * (x - mean x).

    Means come from the background rows through one aggregation.
    """
    background = df if background is None else background
    means = background.agg(F.struct(*[F.avg(c).alias(c) for c in weights])).scalar()
    return df.withColumns(
        {f"attribution_{c}": w * (F.col(c) - means[c]) for c, w in weights.items()}
    )


def kmeans_background(encoded: DataFrame, k: int = 10, seed: int = 42) -> list[tuple[list, int]]:
    """Centres of ``k`` clusters with their sizes: a summary of fixed size."""
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, featuresCol="features").fit(encoded)
    sizes = model.summary.clusterSizes
    return [([float(v) for v in c], int(n)) for c, n in zip(model.clusterCenters(), sizes)]


def sampled_attribution(
    encoded: DataFrame,
    key: str,
    trained,
    centres: list[tuple[list, int]],
    permutations: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Monte-Carlo Shapley values of every encoded feature of every row.

    For each of ``permutations`` fixed feature orders and each background
    centre, features switch one by one from the centre to the row; the change
    of the prediction (of classes: their number) goes to the feature just
    switched. The ``permutations * centres * (slots + 1)`` mixtures of a row
    exist only inside a task, a block at a time; one row per record and slot
    comes out: ``key``, ``slot``, ``attribution``.
    """
    spark = encoded.sparkSession
    slots = len(centres[0][0])
    rng = random.Random(seed)
    total = float(sum(n for _, n in centres))
    plans = []
    for _ in range(permutations):
        order = list(range(slots))
        rng.shuffle(order)
        # Place of each slot in the order in which features switch.
        plans.append(np.argsort(order))
    points = np.array([c for c, _ in centres], float)
    weights = np.array([n / total / permutations for _, n in centres])
    shared = spark.sparkContext.broadcast(outputs_of(spark, trained.model))
    block = max(1, BLOCK_ROWS // (len(points) * (slots + 1)))

    def predictions(x: np.ndarray) -> np.ndarray:
        out = shared.value.predict(x)
        return out[:, 0] if out.shape[1] == 1 else out.argmax(1).astype(float)

    @F.pandas_udf("array<double>")
    def shares(features: pd.Series) -> pd.Series:
        rows = np.stack(features.to_numpy()) if len(features) else np.zeros((0, slots))
        out = np.zeros(rows.shape)
        for at in range(0, len(rows), block):
            mine = rows[at : at + block, None, None, :]
            for place in plans:
                switched = place < np.arange(slots + 1)[:, None]
                mixed = np.where(switched, mine, points[:, None, :])
                found = predictions(mixed.reshape(-1, slots)).reshape(mixed.shape[:3])
                gains = np.einsum("rcs,c->rs", np.diff(found, axis=2), weights)
                out[at : at + block] += gains[:, place]
        return pd.Series(list(out))

    return spread(encoded).select(key, shares(vector_to_array("features")).alias("shares")).select(
        key, F.posexplode("shares").alias("slot", "attribution")
    )


Scenario = dict[str, Column]


def scenarios() -> dict[str, Scenario]:
    """Documented interventions as column overrides."""
    c = F.col
    return {
        "halve_car_use": {
            "distance_km": F.when(c("transport_mode") == "Car", c("distance_km") / 2).otherwise(
                c("distance_km")
            )
        },
        "renewables_25_to_75": {
            "renewable_usage_pct": F.when(
                c("renewable_usage_pct") <= 25, F.lit(75.0)
            ).otherwise(c("renewable_usage_pct"))
        },
        "electricity_minus_30_pct": {"electricity_kwh": c("electricity_kwh") * 0.7},
        "non_veg_to_veg": {
            "food_type": F.when(c("food_type") == "Non-Veg", "Veg").otherwise(c("food_type"))
        },
    }


def what_if(
    df: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    plans: dict[str, Scenario] | None = None,
) -> DataFrame:
    """Mean footprint of all rows under each scenario, and what it changes.

    ``mean_change`` is over all rows; ``affected_rows`` are those whose fields
    the scenario changes. Each row is expanded into one copy per scenario plus
    the unchanged one, in place, and scored; one aggregation then compares the
    copies.
    """
    plans = scenarios() if plans is None else plans
    changed = sorted({c for overrides in plans.values() for c in overrides})
    names = ["baseline", *plans]
    copies = df.select(
        *df.columns, F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario")
    )

    def value(column: str) -> Column:
        out = F
        for name, overrides in plans.items():
            if column in overrides:
                out = out.when(F.col("scenario") == name, overrides[column])
        return out.otherwise(F.col(column))

    # All overrides read the original values.
    affected = F.lit(False)
    for c in changed:
        affected = affected | ~value(c).eqNullSafe(F.col(c))
    overridden = copies.select(
        *[c for c in copies.columns if c not in changed],
        *[value(c).alias(c) for c in changed],
        affected.alias("is_affected"),
    )
    means = scorer(overridden).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_affected").alias("affected_rows"),
        F.avg(FOOTPRINT).alias("mean_footprint"),
    )
    baseline = (
        means.where(F.col("scenario") == "baseline").select("mean_footprint").scalar()
    )
    return means.where(F.col("scenario") != "baseline").select(
        "scenario",
        "rows",
        "affected_rows",
        "mean_footprint",
        (F.col("mean_footprint") - baseline).alias("mean_change"),
    )


def record_attributions(encoded: DataFrame, trained, background: DataFrame) -> DataFrame:
    """``encoded`` with ``attributions``: encoded feature name to its share of the prediction.

    Exact for a linear model: coefficient times the distance to the background
    mean; the shares of a record add up to its prediction minus the mean one.
    """
    names = feature_names(trained.preprocessor)
    weights = [float(v) for v in trained.model.coefficients]
    values = vector_to_array("features")
    means = background.select(values.alias("x")).agg(
        F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(len(names))])
    ).scalar()
    shares = [
        F.lit(w) * (F.get("x", F.lit(i)) - F.get("mean_x", F.lit(i))) for i, w in enumerate(weights)
    ]
    return (
        encoded.withColumns({"x": values, "mean_x": means})
        .withColumn("attributions", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*shares)))
        .drop("x", "mean_x")
    )


def explain_sample(
    spark: SparkSession, df: DataFrame, trained, background: DataFrame | None = None
) -> DataFrame:
    """Prediction, contributions, Shapley values and field values of the given records.

    ``df`` holds the records to explain, usually one picked by its key. Linear
    models give each record its own attributions against ``background`` (by
    default the records themselves). For tree models ``feature_contributions``
    holds the ten largest importances, as published, and ``shap_values`` the
    record's own values: they add up to ``explained_output`` minus
    ``expected_output``. The output is the prediction, or for classes the
    predicted level's probability (forests) or margin (boosting).
    Classification models add their probabilities.
    """
    if hasattr(trained.model, "coefficients"):
        encoded = trained.encode(df)
        mean = trained.encode(df if background is None else background)
        explained = trained.apply(record_attributions(encoded, trained, mean))
        return explained.select(
            *df.columns,
            f"{FOOTPRINT}_predicted",
            F.col("attributions").alias("feature_contributions"),
            F.to_json(F.struct(*FEATURES)).alias("feature_values"),
        )

    top = importance_frame(spark, trained, 10).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
    )
    ensemble = tree_ensemble(spark, trained.model)
    names = feature_names(trained.preprocessor)
    explained = trained.apply(trained.ordered(trained.encode(spread(df)))).withColumn(
        "shapley", shapley_column(spark, ensemble, len(names))
    )
    if trained.config.model_type == "regression":
        output, own = F.lit(1), F.col(f"{FOOTPRINT}_predicted")
        added = [f"{FOOTPRINT}_predicted"]
    else:
        output = F.array_position(F.array(*map(F.lit, LEVELS)), F.col(f"{LEVEL}_predicted")).cast("int")
        column = "rawPrediction" if hasattr(trained.model, "models") else "probability"
        own = F.element_at(vector_to_array(column), output)
        added = [f"{LEVEL}_predicted", "class_probabilities"]
    expected = F.array(*[F.lit(float(v)) for v in ensemble.expected()])
    shap = F.map_from_arrays(F.array(*map(F.lit, names)), F.element_at("shapley", output))
    return explained.select(
        *df.columns,
        *added,
        top.scalar().alias("feature_contributions"),
        F.to_json(F.struct(*FEATURES)).alias("feature_values"),
        shap.alias("shap_values"),
        own.alias("explained_output"),
        F.element_at(expected, output).alias("expected_output"),
    )


def kernel_attribution(
    encoded: DataFrame,
    trained,
    centres: list[tuple[list, int]],
    budget: int = 512,
    batches: int = 8,
    seed: int = 42,
) -> DataFrame:
    """``encoded`` with ``shap_values``, ``shap_errors`` and ``base_values``: one array for each output.

    ``centres`` is the background, see ``kmeans_background``; ``budget`` the
    number of coalitions. Outputs are the prediction, class probabilities, or
    the margins of a one-vs-rest model.
    """
    spark = encoded.sparkSession
    explainer = KernelExplainer.of(outputs_of(spark, trained.model), centres, budget, batches, seed)
    base = F.array(*[F.lit(float(v)) for v in explainer.base])
    return (
        spread(encoded).withColumn("kernel", kernel_columns(spark, explainer))
        .withColumns({"shap_values": F.col("kernel.values"), "shap_errors": F.col("kernel.errors"), "base_values": base})
        .drop("kernel")
    )


def global_explanation(spark: SparkSession, trained, k: int = 20) -> DataFrame:
    """Settings, metrics and the ``k`` largest importances of a model, long."""
    config = trained.config
    rows = [
        ("model", "model_type", config.model_type, None),
        ("model", "algorithm", config.algorithm, None),
        ("model", "feature_engineering", str(config.feature_engineering), None),
    ] + [
        ("performance", name, None, float(value))
        for name, value in trained.metrics.items()
        if isinstance(value, (int, float))
    ]
    settings = spark.createDataFrame(
        rows, "section string, name string, text string, value double"
    )
    importances = importance_frame(spark, trained, k).select(
        F.lit("feature_importance").alias("section"),
        F.col("feature").alias("name"),
        F.lit(None).cast("string").alias("text"),
        F.col("importance").alias("value"),
    )
    return settings.unionByName(importances)
