"""Readable explanations of a score."""

from pyspark.sql import Column, functions as F

from dayprint.functions.text import array_of, fixed, joined, quoted

# Texts of the explanations.
CONTEXT = {
    "Low": "This is below average and indicates sustainable lifestyle choices.",
    "Medium": "This is around average. There are opportunities for improvement.",
    "High": "This is above average. Significant reductions are possible with changes.",
}
OBSERVATIONS = {
    "car": "Using a car for longer distances significantly increases emissions.",
    "renewables": "Low renewable energy usage contributes to higher carbon footprint.",
    "diet": "Non-vegetarian diets typically have higher carbon footprints.",
    "habits": "Increasing eco-friendly actions can help reduce your footprint.",
}
NOTES = {
    "car": "Using a car for longer distances significantly increases your carbon footprint.",
    "renewables": "Low renewable energy usage contributes to higher emissions.",
    "diet": "Non-vegetarian diets typically have higher carbon footprints.",
}


def _observed(level: str) -> dict[str, str]:
    return {
        "car": "transport_mode = 'Car' and distance_km > 10",
        "renewables": "renewable_usage_pct < 30",
        "diet": f"food_type = 'Non-Veg' and {level} in ('Medium', 'High')",
        "habits": "eco_actions < 2",
    }


def explanation(footprint: str, level: str, shares: str) -> Column:
    """Several lines: headline, context, top two factors, observations.

    Takes the names of the footprint, level and ranked-shares columns.
    """
    first, second = f"try_element_at({shares}, 1)", f"try_element_at({shares}, 2)"
    notes = array_of(
        [
            f"case when {condition} then {quoted(f'- {OBSERVATIONS[name]}')} end"
            for name, condition in _observed(level).items()
        ]
    )
    context = " ".join(
        f"when {level} = {quoted(k)} then {quoted(CONTEXT[k])}" for k in ("Low", "Medium")
    )
    return F.expr(
        f"""concat_ws('\n',
            concat('Your daily carbon footprint is estimated at ', {fixed(footprint, 1)},
                ' kg CO₂, which is classified as **', {level}, '** impact.'),
            case {context} else {quoted(CONTEXT['High'])} end,
            concat('\nThe main contributor to your footprint is **', {first}.factor, '** (',
                {fixed(f'{first}.percentage', 1)}, '% of total impact).'),
            concat('Followed by **', {second}.factor, '** (',
                {fixed(f'{second}.percentage', 1)}, '%).'),
            case when size({notes}) > 0 then '\n**Key observations:**' end,
            {notes})"""
    )


def service_explanation(footprint: str, level: str, shares: str) -> Column:
    """Plain text: headline, top two factors, notes."""
    first, second = f"try_element_at({shares}, 1)", f"try_element_at({shares}, 2)"
    observed = _observed(level)
    notes = ", ".join(
        f"case when {observed[name]} then {quoted(f'{chr(10)}{chr(10)}Note: {text}')} else '' end"
        for name, text in NOTES.items()
    )
    followed = joined(
        quoted("Followed by '"), f"{second}.factor", quoted("' ("),
        fixed(f"{second}.percentage", 1), quoted("%)."),
    )
    factors = joined(
        quoted("The main factor contributing to your footprint is '"), f"{first}.factor",
        quoted("' ("), fixed(f"{first}.percentage", 1), quoted("%). "),
        f"coalesce({followed}, '')",
    )
    return F.expr(
        f"""concat('Your predicted carbon footprint is ', {fixed(footprint, 1)},
            ' kg CO₂ per day, which is classified as ', {level}, ' impact.\n\n',
            coalesce({factors}, ''), {notes})"""
    )
