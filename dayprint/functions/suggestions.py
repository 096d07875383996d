"""Reduction suggestions: rules as data, evaluated as one array expression."""

from pyspark.sql import Column, functions as F

from dayprint.constants import LEVEL
from dayprint.functions.text import array_of, quoted

MAX_SUGGESTIONS = 3


# Texts of the library's suggestions
# (category, action, impact, estimated_reduction, reason).
CORE_FIELDS = ("category", "action", "impact", "estimated_reduction", "reason")
CORE_TEXTS = {
    "transport": (
        "Transport",
        "Switch to public transport, cycling, or walking",
        "High",
        "1-3 kg CO₂/day",
        "Car usage is the largest contributor to your carbon footprint",
    ),
    "renewables": (
        "Energy",
        "Increase renewable energy usage",
        "High",
        "0.5-2 kg CO₂/day",
        "Low renewable energy percentage increases emissions",
    ),
    "diet": (
        "Food",
        "Incorporate more plant-based meals",
        "Medium",
        "0.5-1.5 kg CO₂/day",
        "Non-vegetarian diets have higher carbon footprints",
    ),
    "electricity": (
        "Energy",
        "Reduce electricity consumption",
        "Medium",
        "0.3-1 kg CO₂/day",
        "High electricity usage contributes significantly",
    ),
    "waste": (
        "Waste",
        "Improve recycling and composting",
        "Medium",
        "0.2-0.5 kg CO₂/day",
        "Reducing waste lowers emissions from landfills",
    ),
    "habits": (
        "Lifestyle",
        "Increase eco-friendly actions",
        "Low",
        "0.1-0.3 kg CO₂/day",
        "More eco-actions can reduce your footprint",
    ),
    "keep_going": (
        "Maintenance",
        "Continue sustainable practices",
        "N/A",
        "Maintain current level",
        "You are already doing well! Keep up the good work",
    ),
    "full_renewables": (
        "Energy",
        "Aim for 100% renewable energy",
        "Low",
        "Additional 0.2-0.5 kg CO₂/day",
        "Achieving full renewable usage further reduces emissions",
    ),
    "screens": (
        "Digital",
        "Reduce screen time and enable power saving",
        "Low",
        "0.1-0.3 kg CO₂/day",
        "High screen time increases electricity consumption",
    ),
}

# Texts of the service's suggestions
# (category, suggestion, potential_reduction).
SERVICE_FIELDS = ("category", "suggestion", "potential_reduction")
SERVICE_TEXTS = {
    "transport": (
        "Transport",
        "Consider using public transport, cycling, or walking for trips under 10km",
        "1-3 kg CO₂/day",
    ),
    "renewables": (
        "Energy",
        "Switch to a renewable energy provider or consider solar panels",
        "0.5-2 kg CO₂/day",
    ),
    "diet": (
        "Food",
        "Try incorporating more plant-based meals into your diet",
        "0.5-1.5 kg CO₂/day",
    ),
    "electricity": (
        "Energy",
        "Reduce electricity usage by turning off unused appliances and using LED lights",
        "0.3-1 kg CO₂/day",
    ),
    "waste": (
        "Waste",
        "Improve recycling and composting to reduce waste",
        "0.2-0.5 kg CO₂/day",
    ),
    "habits": (
        "Lifestyle",
        "Increase eco-friendly actions like using reusable bags and bottles",
        "0.1-0.3 kg CO₂/day",
    ),
    "keep_going": (
        "Maintenance",
        "Great job! Continue your sustainable practices",
        "Keep up the good work!",
    ),
    "full_renewables": (
        "Energy",
        "Consider reaching 100% renewable energy",
        "Additional 0.2-0.5 kg CO₂/day reduction",
    ),
    "screens": (
        "Digital",
        "Reduce screen time and enable energy saving modes on devices",
        "0.1-0.3 kg CO₂/day",
    ),
}

# Renewable share below which a High day gets the energy advice.
RENEWABLE_CUTOFF = {"core": 30, "service": 50}


def _conditions(level: str, renewable_cutoff: int) -> dict[str, str]:
    calm = f"not coalesce({level} in ('High', 'Medium'), false)"
    return {
        "transport": f"{level} = 'High' and transport_mode = 'Car' and distance_km > 5",
        "renewables": f"{level} = 'High' and renewable_usage_pct < {renewable_cutoff}",
        "diet": f"{level} = 'High' and food_type = 'Non-Veg'",
        "electricity": f"{level} = 'Medium' and electricity_kwh > 8",
        "waste": f"{level} = 'Medium' and waste_generated_kg > 0.7D",
        "habits": f"{level} = 'Medium' and eco_actions < 3",
        "keep_going": calm,
        "full_renewables": f"{calm} and renewable_usage_pct < 100",
        "screens": "screen_time_hours > 6",
    }


def suggestions(level: str = LEVEL, variant: str = "core") -> Column:
    """Matching suggestions in rule order, cut to the first three."""
    if variant == "core":
        fields, texts = CORE_FIELDS, CORE_TEXTS
    elif variant == "service":
        fields, texts = SERVICE_FIELDS, SERVICE_TEXTS
    else:
        raise ValueError(f"Unknown suggestion variant: {variant}")

    def offer(name: str) -> str:
        pairs = [f"{quoted(f)}, {quoted(t)}" for f, t in zip(fields, texts[name])]
        return f"named_struct({', '.join(pairs)})"

    options = [
        f"case when {condition} then {offer(name)} end"
        for name, condition in _conditions(level, RENEWABLE_CUTOFF[variant]).items()
    ]
    return F.expr(f"slice({array_of(options)}, 1, {MAX_SUGGESTIONS})")
