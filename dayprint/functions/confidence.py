"""Confidence of a score and the readable summary of its input."""

from pyspark.sql import Column, functions as F

from dayprint.constants import DEFAULT_CONFIDENCE, DEFAULT_TARGET_STATS


def regression_confidence(prediction: Column, stats: dict | None) -> Column:
    """Bell-shaped closeness to the training mean, kept inside [0.5, 0.95].

    ``stats`` maps mean, std, min and max to numbers or columns. A missing
    field takes its default; no statistics at all give the default confidence.
    """
    default = F.lit(DEFAULT_CONFIDENCE)
    if stats is None:
        return default
    s = {
        k: v if isinstance(v, Column) else F.lit(float(v))
        for k, v in {**DEFAULT_TARGET_STATS, **stats}.items()
    }
    z = F.try_divide(prediction - s["mean"], s["std"])
    bell = F.exp(-0.5 * z * z)
    return F.when(
        prediction.between(s["min"], s["max"]),
        F.greatest(F.lit(0.5), F.least(F.lit(0.95), bell)),
    ).otherwise(default)


def class_confidence(probabilities: Column) -> Column:
    """Largest of an array of probabilities, or the default without any."""
    return F.coalesce(F.array_max(probabilities), F.lit(DEFAULT_CONFIDENCE))


def overall_confidence(regression: Column, classification: Column) -> Column:
    return (regression + classification) / 2


def input_summary() -> Column:
    return F.expr(
        """named_struct(
            'transport', concat(transport_mode, ' (', string(distance_km), ' km)'),
            'energy', concat(
                string(electricity_kwh), ' kWh, ', string(renewable_usage_pct), '% renewable'),
            'food', food_type,
            'lifestyle', named_struct(
                'screen_time', concat(string(screen_time_hours), ' hours'),
                'waste', concat(string(waste_generated_kg), ' kg'),
                'eco_actions', eco_actions),
            'day_type', day_type)"""
    )


def prediction_id(timestamp: Column, key: Column) -> Column:
    """Stable id from the scoring time and a hash of the key that any engine can compute."""
    return F.concat(
        F.lit("pred_"),
        F.date_format(timestamp, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        F.lpad(
            F.pmod(
                F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long"), F.lit(10000)
            ).cast("string"),
            4,
            "0",
        ),
    )


def batch_prediction_id(timestamp: Column, index: Column) -> Column:
    padded = F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(
        index.cast("string")
    )
    return F.concat(
        F.lit("batch_"), F.date_format(timestamp, "yyyyMMdd_HHmmss"), F.lit("_"), padded
    )
