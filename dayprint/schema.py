"""Explicit schemas: no job infers types from data."""

from pyspark.sql import types as T

from dayprint.constants import FEATURES, FOOTPRINT, LEVEL, USER_KEY

_FEATURE_TYPES = {
    "day_type": T.StringType(),
    "transport_mode": T.StringType(),
    "distance_km": T.DoubleType(),
    "electricity_kwh": T.DoubleType(),
    "renewable_usage_pct": T.DoubleType(),
    "food_type": T.StringType(),
    "screen_time_hours": T.DoubleType(),
    "waste_generated_kg": T.DoubleType(),
    "eco_actions": T.IntegerType(),
}

FEATURE_SCHEMA = T.StructType([T.StructField(c, _FEATURE_TYPES[c]) for c in FEATURES])

ACTIVITY_SCHEMA = T.StructType(
    [T.StructField(USER_KEY, T.LongType())]
    + FEATURE_SCHEMA.fields
    + [T.StructField(FOOTPRINT, T.DoubleType()), T.StructField(LEVEL, T.StringType())]
)

# Untyped arrivals (CSV cells, JSON values): everything is text until coerced.
RAW_FEATURE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FEATURES])

SUGGESTION_TYPE = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("impact", T.StringType()),
        T.StructField("estimated_reduction", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
SERVICE_SUGGESTION_TYPE = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("potential_reduction", T.StringType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Nested sample predictions: one input record with one output record.
SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("input", FEATURE_SCHEMA),
        T.StructField(
            "output",
            T.StructType(
                [
                    T.StructField(FOOTPRINT, T.DoubleType()),
                    T.StructField(LEVEL, T.StringType()),
                    T.StructField("confidence", T.DoubleType()),
                    T.StructField(
                        "probabilities", T.MapType(T.StringType(), T.DoubleType())
                    ),
                    T.StructField("suggestions", T.ArrayType(SUGGESTION_TYPE)),
                ]
            ),
        ),
    ]
)
