"""Plausibility of a score and of the record behind it."""

from pyspark.sql import Column, functions as F

from dayprint.constants import EXTREME_THRESHOLDS, FOOTPRINT, LEVEL, PLAUSIBLE_FOOTPRINT
from dayprint.functions.features import level_sql
from dayprint.functions.text import array_of, double, fixed


def warnings_sql(footprint: str, level: str) -> str:
    low, high = PLAUSIBLE_FOOTPRINT
    expected = level_sql(footprint)

    def long_trip(mode: str, limit: int, verb: str) -> str:
        return f"""case when transport_mode = '{mode}' and distance_km > {limit}
            then concat('{verb} distance (', string(distance_km), ' km) seems unusually high')
            end"""

    return array_of(
        [
            f"""case when {footprint} not between {double(low)} and {double(high)}
                then concat('Carbon footprint (', {fixed(footprint, 2)},
                    ' kg) outside typical range ({low}-{high} kg)') end""",
            f"""case when {footprint} is not null and {expected} != {level}
                then concat('Impact level \\'', {level}, '\\' doesn\\'t match expected level \\'',
                    {expected}, '\\' for footprint ', {fixed(footprint, 2)}, ' kg') end""",
            long_trip("Walk", 30, "Walking"),
            long_trip("Bike", 50, "Biking"),
            *[
                f"""case when {name} > {limit}
                    then concat('{name} (', string({name}), ') seems unusually high') end"""
                for name, limit in EXTREME_THRESHOLDS.items()
            ],
        ]
    )


def errors_sql() -> str:
    return array_of(
        [
            """case when renewable_usage_pct > 100 then concat(
                'Renewable usage (', string(renewable_usage_pct), '%) cannot exceed 100%') end""",
            """case when eco_actions < 0 then concat(
                'Eco actions (', string(eco_actions), ') cannot be negative') end""",
        ]
    )


def plausibility(footprint: str = FOOTPRINT, level: str = LEVEL) -> Column:
    """Struct of is_valid, warnings and errors; only errors make it invalid."""
    return F.expr(
        f"""named_struct('is_valid', size({errors_sql()}) = 0,
            'warnings', {warnings_sql(footprint, level)}, 'errors', {errors_sql()})"""
    )
