"""Simple models that plain SQL can reproduce, to check the operators with.

``segment``: mean footprint and level shares per transport mode and diet.
``linear``: least squares on electricity alone. Both learn from the train rows
of the hash split; there are at most 15 segments, so they are broadcast.
"""

from pyspark.sql import DataFrame, functions as F

from dayprint.constants import DOMAINS, FOOTPRINT, LEVEL, LEVELS
from dayprint.functions.features import impact_level
from dayprint.functions.text import text_list
from dayprint.operators.splits import hash_split
from dayprint.sources.workdir import materialise

SEGMENT = ["transport_mode", "food_type"]
KNOWN_SEGMENT = " and ".join(f"{k} in ({text_list(DOMAINS[k])})" for k in SEGMENT)


def split_activity(df: DataFrame) -> DataFrame:
    return hash_split(df, "record_id")


def segment_model(train: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    """At most one row per pair of known categories."""
    known = " and ".join(f"{k} in ({text_list(DOMAINS[k])})" for k in keys)
    shares = [
        F.expr(f"round(avg(if({LEVEL} = '{v}', 1.0D, 0.0D)), 6) as p_{v.lower()}") for v in LEVELS
    ]
    return train.where(known).groupBy(*keys).agg(
        F.expr(f"round(avg({FOOTPRINT}), 6) as segment_mean"), *shares
    )


def linear_model(train: DataFrame):
    """Struct of slope and intercept, as a scalar subquery."""
    return train.agg(
        F.struct(
            F.round(F.regr_slope(FOOTPRINT, "electricity_kwh"), 6).alias("slope"),
            F.round(F.regr_intercept(FOOTPRINT, "electricity_kwh"), 6).alias("intercept"),
        )
    ).scalar()


def with_segments(df: DataFrame, train: DataFrame, keys: list[str] = SEGMENT) -> DataFrame:
    return df.join(F.broadcast(segment_model(train, keys)), keys, "left")


def segment_scorer(train: DataFrame, store: bool = False):
    """Scorer for ``score_batch`` from the segment model.

    With ``store`` the few rows of the model are written first, so that a
    stream does not learn them again in every micro-batch.
    """
    model = segment_model(train)
    if store:
        model = materialise(model, "segments")

    def score(df: DataFrame) -> DataFrame:
        return (
            df.join(F.broadcast(model), SEGMENT, "left")
            .withColumn(FOOTPRINT, F.col("segment_mean"))
            .withColumn(LEVEL, impact_level(FOOTPRINT))
            .withColumn("class_probabilities", F.array("p_low", "p_medium", "p_high"))
            .drop("segment_mean", "p_low", "p_medium", "p_high")
        )

    return score


def predictions(df: DataFrame) -> DataFrame:
    """Records with ``split`` and the predictions of both models."""
    rows = split_activity(df)
    train = rows.where(F.col("split") == "train")
    line = linear_model(train)
    return with_segments(rows, train).withColumns(
        {
            "linear_pred": F.round(
                line["intercept"] + line["slope"] * F.col("electricity_kwh"), 6
            ),
            "segment_level": impact_level("segment_mean"),
        }
    ).withColumn("linear_level", impact_level("linear_pred"))


def long_predictions(df: DataFrame) -> DataFrame:
    """One row per record and model: algorithm, label, prediction, levels."""
    models = ", ".join(
        f"""named_struct('algorithm', '{name}', 'label', {FOOTPRINT}, 'prediction', {pred},
            'level', {LEVEL}, 'predicted_level', {level})"""
        for name, pred, level in [
            ("linear", "linear_pred", "linear_level"),
            ("segment", "segment_mean", "segment_level"),
        ]
    )
    return predictions(df).selectExpr("record_id", "split", f"inline(array({models}))")
