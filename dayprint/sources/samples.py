"""Sample records and sample predictions."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayprint.constants import FEATURES, SAMPLE_RECORD
from dayprint.schema import FEATURE_SCHEMA, SAMPLE_SCHEMA

# Predictions shown when no sample file is given.
_DEFAULTS = [
    (SAMPLE_RECORD, (10.25, "High", 0.85)),
    (
        {
            "day_type": "Weekend",
            "transport_mode": "Bike",
            "distance_km": 5.0,
            "electricity_kwh": 3.5,
            "renewable_usage_pct": 75.0,
            "food_type": "Veg",
            "screen_time_hours": 3.0,
            "waste_generated_kg": 0.3,
            "eco_actions": 5,
        },
        (4.75, "Low", 0.92),
    ),
]


def sample_input(spark: SparkSession) -> DataFrame:
    """The example record as a one-row frame."""
    return spark.createDataFrame([tuple(SAMPLE_RECORD[c] for c in FEATURES)], FEATURE_SCHEMA)


def sample_predictions(
    spark: SparkSession, path: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Nested sample predictions from json, or the built-in ones without a path."""
    if path is not None:
        return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", multi_line).json(path)
    rows = [
        (tuple(record[c] for c in FEATURES), (*result, None, None))
        for record, result in _DEFAULTS
    ]
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def sample_suggestions(samples: DataFrame, *keep: str) -> DataFrame:
    """One row per suggestion of each sample."""
    return samples.select(
        *keep, F.posexplode("output.suggestions").alias("position", "suggestion")
    ).select(*keep, "position", "suggestion.*")
