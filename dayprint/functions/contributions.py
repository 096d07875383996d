"""Rule-based feature contributions and their ranking.

A contribution list is ``array<struct<feature, value>>`` in a fixed order, so
that equal shares keep that order when they are ranked. ``as_map`` turns it
into the published ``map<string,double>``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from dayprint.constants import (
    DAY_WEIGHTS,
    FACTOR_DESCRIPTIONS,
    FEATURES,
    FOOD_WEIGHTS,
    TRANSPORT_WEIGHTS,
)
from dayprint.functions.features import ENERGY_EFFICIENCY, lookup_sql
from dayprint.functions.text import double, quoted

# Weights per unit.
ENERGY_WEIGHT = 0.3
WASTE_WEIGHT = 0.4
ECO_ACTION_WEIGHT = -0.15
SCREEN_WEIGHT = 0.1
DISTANCE_WEIGHT = 0.05
RENEWABLE_WEIGHT = -0.02
# Weight of an unknown category and the size a record is scaled to.
UNKNOWN_CATEGORY_WEIGHT = 0.5
TYPICAL_FOOTPRINT = 8.0


def _entries(values: dict[str, str]) -> str:
    pairs = [f"named_struct('feature', {quoted(k)}, 'value', {v})" for k, v in values.items()]
    return f"array({', '.join(pairs)})"


def raw_contributions() -> dict[str, str]:
    """Unscaled parts of a record, by factor, as SQL."""
    mode = lookup_sql("transport_mode", TRANSPORT_WEIGHTS, UNKNOWN_CATEGORY_WEIGHT)
    return {
        "transport": f"{mode} * (distance_km / 10)",
        "energy": f"{ENERGY_EFFICIENCY} * {double(ENERGY_WEIGHT)}",
        "food": lookup_sql("food_type", FOOD_WEIGHTS, UNKNOWN_CATEGORY_WEIGHT),
        "waste": f"waste_generated_kg * {double(WASTE_WEIGHT)}",
        "eco_actions": f"eco_actions * {double(ECO_ACTION_WEIGHT)}",
        "screen_time": f"screen_time_hours * {double(SCREEN_WEIGHT)}",
    }


CORE_FACTORS = list(raw_contributions())
SERVICE_FACTORS = FEATURES


def with_contributions(df: DataFrame, name: str = "contributions") -> DataFrame:
    """Add contributions scaled to a typical footprint, rounded to 3 places.

    The parts and their scale are columns of their own steps, so that each is
    computed once per row and the generated code stays small.
    """
    raw = list(raw_contributions().values())
    total = " + ".join(["0.0D", *[f"abs(raw_parts[{i}])" for i in range(len(raw))]])
    # Thousandths are rounded as doubles: rounding the shortest text of 2.0475 would lift a number just below the tie.
    scaled = {k: f"round(raw_parts[{i}] * parts_scale * 1000.0D) / 1000.0D" for i, k in enumerate(CORE_FACTORS)}
    return (
        df.withColumn("raw_parts", F.expr(f"array({', '.join(raw)})"))
        .withColumn("parts_total", F.expr(total))
        .withColumn(
            "parts_scale",
            F.expr(f"if(parts_total > 0, {double(TYPICAL_FOOTPRINT)} / parts_total, 1.0D)"),
        )
        .withColumn(name, F.expr(_entries(scaled)))
        .drop("raw_parts", "parts_total", "parts_scale")
    )


def service_contributions() -> Column:
    """Nine raw weights, one per input field."""
    return F.expr(
        _entries(
            {
                "day_type": lookup_sql("day_type", DAY_WEIGHTS, 0.0),
                "transport_mode": lookup_sql("transport_mode", TRANSPORT_WEIGHTS, 0.0),
                "distance_km": f"distance_km * {double(DISTANCE_WEIGHT)}",
                "electricity_kwh": f"electricity_kwh * {double(ENERGY_WEIGHT)}",
                "renewable_usage_pct": f"renewable_usage_pct * {double(RENEWABLE_WEIGHT)}",
                "food_type": lookup_sql("food_type", FOOD_WEIGHTS, 0.0),
                "screen_time_hours": f"screen_time_hours * {double(SCREEN_WEIGHT)}",
                "waste_generated_kg": f"waste_generated_kg * {double(WASTE_WEIGHT)}",
                "eco_actions": f"eco_actions * {double(ECO_ACTION_WEIGHT)}",
            }
        )
    )


def as_map(entries: Column) -> Column:
    return F.map_from_entries(entries)


def with_ranked_shares(
    df: DataFrame,
    entries: str = "contributions",
    factors: list[str] = CORE_FACTORS,
    places: int | None = 1,
    name: str = "shares",
) -> DataFrame:
    """Add the shares of the absolute total in percent, largest first.

    ``entries`` names a contribution column with these ``factors``. The result
    is ``array<struct<percentage, order, factor>>``, empty when every
    contribution is zero; ``order`` keeps equal shares in feature order.
    ``places=None`` keeps the shares unrounded. Ranking sorts a short array
    inside the row, in generated code and without a shuffle.
    """
    sizes = [f"abs({entries}[{i}].value)" for i in range(len(factors))]

    total = " + ".join(["0.0D", *sizes])

    def share(size: str) -> str:
        pct = f"try_divide({size}, {total}) * 100"
        return pct if places is None else f"round({pct}, {places})"

    structs = ", ".join(
        f"named_struct('percentage', {share(size)}, 'order', {-i}, 'factor', {quoted(factor)})"
        for i, (size, factor) in enumerate(zip(sizes, factors))
    )
    # A total of zero leaves nothing to share out.
    ranked = f"""slice(sort_array(array({structs}), false), 1,
        if({total} > 0, {len(factors)}, 0))"""
    return df.withColumn(name, F.expr(ranked))


def top_factors(shares: str, k: int = 3) -> Column:
    return F.expr(f"slice({shares}, 1, {k})")


def describe_factor(factor: str) -> str:
    """Description of a factor; an unknown factor describes itself."""
    cases = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in FACTOR_DESCRIPTIONS.items())
    return f"(case {factor} {cases} else {factor} end)"


def key_factors(shares: str, k: int = 3) -> Column:
    return F.expr(
        f"""transform(slice({shares}, 1, {k}), s -> named_struct(
            'factor', s.factor, 'percentage', s.percentage,
            'description', {describe_factor('s.factor')}))"""
    )
