"""Engineered features of one record.

Functions named ``*_sql`` give SQL text to build larger expressions from.
"""

from pyspark.sql import Column, functions as F

from dayprint.constants import (
    FOOD_SUSTAINABILITY,
    HIGH_THRESHOLD,
    LOW_THRESHOLD,
    TRANSPORT_WEIGHTS,
)
from dayprint.functions.text import double, quoted


def lookup_sql(column: str, weights: dict[str, float], default: float | None = None) -> str:
    """Weight of a category; unknown categories get the default."""
    branches = " ".join(f"when {quoted(k)} then {double(v)}" for k, v in weights.items())
    rest = "cast(null as double)" if default is None else double(default)
    return f"(case {column} {branches} else {rest} end)"


TRANSPORT_IMPACT = f"distance_km * {lookup_sql('transport_mode', TRANSPORT_WEIGHTS)}"
ENERGY_EFFICIENCY = "electricity_kwh * (100 - renewable_usage_pct) / 100"


def transport_impact_score() -> Column:
    return F.expr(TRANSPORT_IMPACT)


def energy_efficiency() -> Column:
    return F.expr(ENERGY_EFFICIENCY)


def waste_per_activity() -> Column:
    return F.expr("waste_generated_kg / (eco_actions + 1)")


def sustainability_score(max_transport_score: Column) -> Column:
    """Mean of four parts; null when the largest transport score is zero."""
    first = F.expr("renewable_usage_pct / 100 + eco_actions / 5.0D")
    transport = 1 - F.try_divide(transport_impact_score(), max_transport_score)
    food = F.expr(lookup_sql("food_type", FOOD_SUSTAINABILITY))
    return (first + transport + food) / 4


def transport_electricity_interaction() -> Column:
    return F.expr("distance_km * electricity_kwh")


def renewable_waste_interaction() -> Column:
    return F.expr("(100 - renewable_usage_pct) * waste_generated_kg")


def is_weekend() -> Column:
    return F.expr("cast(coalesce(day_type = 'Weekend', false) as int)")


def renewable_bucket() -> Column:
    return F.expr(
        """case when renewable_usage_pct < 25 then '0-25'
                when renewable_usage_pct < 50 then '25-50'
                when renewable_usage_pct < 75 then '50-75'
                when renewable_usage_pct <= 100 then '75-100' end"""
    )


def log_distance() -> Column:
    return F.log1p("distance_km")


def level_sql(footprint: str, low: float = LOW_THRESHOLD, high: float = HIGH_THRESHOLD) -> str:
    """Low, Medium or High; a missing footprint counts as Medium."""
    return (
        f"(case when {footprint} < {double(low)} then 'Low' "
        f"when {footprint} <= {double(high)} then 'Medium' "
        f"when {footprint} > {double(high)} then 'High' else 'Medium' end)"
    )


def impact_level(
    footprint: str, low: float = LOW_THRESHOLD, high: float = HIGH_THRESHOLD
) -> Column:
    return F.expr(level_sql(footprint, low, high))
