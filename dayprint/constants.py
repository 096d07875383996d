"""Field lists, domains, weights and texts shared by every job."""

# Column order of one activity record.
FEATURES = [
    "day_type",
    "transport_mode",
    "distance_km",
    "electricity_kwh",
    "renewable_usage_pct",
    "food_type",
    "screen_time_hours",
    "waste_generated_kg",
    "eco_actions",
]
NUMERIC_FEATURES = [
    "distance_km",
    "electricity_kwh",
    "renewable_usage_pct",
    "screen_time_hours",
    "waste_generated_kg",
    "eco_actions",
]
CATEGORICAL_FEATURES = ["day_type", "transport_mode", "food_type"]
FOOTPRINT = "carbon_footprint_kg"
LEVEL = "carbon_impact_level"
USER_KEY = "user_id"

# Closed domains, in the order error messages list them.
DOMAINS = {
    "day_type": ["Weekday", "Weekend"],
    "transport_mode": ["Walk", "Bike", "Bus", "EV", "Car"],
    "food_type": ["Veg", "Mixed", "Non-Veg"],
}
LEVELS = ["Low", "Medium", "High"]
ERROR_LEVEL = "Error"

# Inclusive numeric ranges, in the order they are checked.
RANGES = {
    "distance_km": (0, 100),
    "electricity_kwh": (0, 50),
    "renewable_usage_pct": (0, 100),
    "screen_time_hours": (0, 24),
    "waste_generated_kg": (0, 10),
    "eco_actions": (0, 10),
}

# Impact level thresholds in kg per day.
LOW_THRESHOLD = 6.5
HIGH_THRESHOLD = 10.5

# Domain weights.
TRANSPORT_WEIGHTS = {"Walk": 0.1, "Bike": 0.2, "Bus": 0.5, "EV": 0.7, "Car": 1.0}
FOOD_WEIGHTS = {"Veg": 0.2, "Mixed": 0.5, "Non-Veg": 0.8}
FOOD_SUSTAINABILITY = {"Veg": 1.0, "Mixed": 0.5, "Non-Veg": 0.0}
DAY_WEIGHTS = {"Weekday": 0.0, "Weekend": -0.1}

# Target statistics assumed when a profile lacks a field.
DEFAULT_TARGET_STATS = {"mean": 8.08, "std": 2.5, "min": 1.79, "max": 16.02}
DEFAULT_CONFIDENCE = 0.7

# Descriptions of the factors in the service's explanations.
FACTOR_DESCRIPTIONS = {
    "transport_mode": "Mode of transportation used",
    "distance_km": "Distance traveled",
    "electricity_kwh": "Electricity consumption",
    "renewable_usage_pct": "Percentage of renewable energy used",
    "food_type": "Type of diet",
    "screen_time_hours": "Screen time duration",
    "waste_generated_kg": "Amount of waste generated",
    "eco_actions": "Number of eco-friendly actions taken",
    "day_type": "Day type (Weekday/Weekend)",
}

# Values above these are reported as unusually high.
EXTREME_THRESHOLDS = {
    "distance_km": 100,
    "electricity_kwh": 30,
    "screen_time_hours": 18,
    "waste_generated_kg": 5,
    "eco_actions": 10,
}
PLAUSIBLE_FOOTPRINT = (1.0, 20.0)

# The example record used in documentation and checks.
SAMPLE_RECORD = {
    "day_type": "Weekday",
    "transport_mode": "Car",
    "distance_km": 15.5,
    "electricity_kwh": 8.2,
    "renewable_usage_pct": 25.0,
    "food_type": "Mixed",
    "screen_time_hours": 6.5,
    "waste_generated_kg": 0.75,
    "eco_actions": 2,
}

# Saved objects a complete model folder must hold.
REQUIRED_ARTEFACTS = [
    "preprocessor",
    "label_encoder",
    "best_regression_model",
    "best_classification_model",
]
