import math

import pytest
from pyspark.sql import functions as F

from dayprint.functions import confidence as conf
from dayprint.functions import contributions as contrib
from dayprint.functions.explanations import explanation, service_explanation
from dayprint.functions.features import impact_level
from dayprint.functions.plausibility import plausibility
from dayprint.functions.suggestions import suggestions
from dayprint.operators import ensemble
from dayprint.operators.stages import engineer_features


def suggested(df, level, variant="core"):
    row = df.withColumn("lv", F.lit(level)).select(suggestions("lv", variant).alias("s")).first()
    return [s["category"] for s in row["s"]]


def test_contributions_of_the_sample(records, sample):
    row = contrib.with_contributions(records(sample), "c").first()
    scale = 8 / 5.145
    parts = {"transport": 1.55, "energy": 1.845, "food": 0.5, "waste": 0.3,
             "eco_actions": -0.3, "screen_time": 0.65}
    assert {e["feature"]: e["value"] for e in row["c"]} == pytest.approx(
        {k: round(v * scale, 3) for k, v in parts.items()}, abs=1e-9
    )
    assert sum(abs(e["value"]) for e in row["c"]) == pytest.approx(8, abs=0.01)


def test_a_contribution_just_below_a_tie_is_rounded_down(records, sample):
    # 0.819 * 8 / 3.2 is 2.0474999999999998757, although its shortest text is 2.0475.
    near = {**sample, "transport_mode": "Bus", "distance_km": 9.42, "electricity_kwh": 7.0, "renewable_usage_pct": 61.0,
            "food_type": "Mixed", "screen_time_hours": 3.5, "waste_generated_kg": 0.1 + 1.8, "eco_actions": 2}
    row = contrib.with_ranked_shares(contrib.with_contributions(records(near), "c"), "c").first()
    assert {e["feature"]: e["value"] for e in row["c"]}["energy"] == 2.047
    assert [(s["factor"], s["percentage"]) for s in row["shares"]][:2] == [("energy", 25.6), ("waste", 23.8)]


def test_unknown_categories_and_empty_record(records, sample):
    odd = {**sample, "transport_mode": "Rocket", "food_type": "Pizza", "day_type": "Holiday"}
    df = records(odd)
    values = {e["feature"]: e["value"] for e in
              df.select(contrib.service_contributions().alias("c")).first()["c"]}
    assert values["transport_mode"] == values["food_type"] == values["day_type"] == 0
    nothing = F.expr("array(named_struct('feature', 'a', 'value', 0.0D))").alias("p")
    assert contrib.with_ranked_shares(df.select(nothing), "p", ["a"]).first()["shares"] == []


def test_equal_shares_keep_feature_order(records, sample):
    parts = F.expr(
        "array(named_struct('feature','a','value',1.0D), named_struct('feature','b','value',-3.0D),"
        "named_struct('feature','c','value',3.0D), named_struct('feature','d','value',1.0D))"
    )
    frame = records(sample).select(parts.alias("p"))
    row = contrib.with_ranked_shares(frame, "p", ["a", "b", "c", "d"]).first()
    assert [(s["factor"], s["percentage"]) for s in row["shares"]] == [
        ("b", 37.5), ("c", 37.5), ("a", 12.5), ("d", 12.5),
    ]


def test_suggestion_rules(records, sample):
    df = records(sample)
    assert suggested(df, "High") == ["Transport", "Energy", "Digital"]
    assert suggested(df, "Medium") == ["Energy", "Waste", "Lifestyle"]
    assert suggested(df, "Low") == ["Maintenance", "Energy", "Digital"]
    heavy = records({**sample, "food_type": "Non-Veg"})
    assert suggested(heavy, "High") == ["Transport", "Energy", "Food"]
    some_green = records({**sample, "renewable_usage_pct": 40.0, "screen_time_hours": 1})
    assert suggested(some_green, "High") == ["Transport"]
    assert suggested(some_green, "High", "service") == ["Transport", "Energy"]
    with pytest.raises(ValueError):
        suggestions("lv", "other")


def test_levels_at_the_thresholds(spark):
    df = spark.createDataFrame([(6.49,), (6.5,), (10.5,), (10.51,), (None,)], "y double")
    assert [r[0] for r in df.select(impact_level("y")).collect()] == [
        "Low", "Medium", "Medium", "High", "Medium",
    ]


def test_regression_confidence(spark):
    df = spark.createDataFrame([(8.08,), (9.5,), (1.0,), (16.0,)], "y double")
    stats = {"mean": 8.08, "std": 2.5, "min": 1.79, "max": 16.02}
    got = [r[0] for r in df.select(conf.regression_confidence(F.col("y"), stats)).collect()]
    assert got == pytest.approx([0.95, math.exp(-0.5 * (1.42 / 2.5) ** 2), 0.7, 0.5])
    partial = [r[0] for r in df.select(conf.regression_confidence(F.col("y"), {})).collect()]
    assert partial == pytest.approx(got)
    none = [r[0] for r in df.select(conf.regression_confidence(F.col("y"), None)).collect()]
    assert none == [0.7] * 4


def test_explanations(records, sample):
    df = records({**sample, "food_type": "Non-Veg", "eco_actions": 1}).withColumns(
        {"y": F.lit(11.04), "lv": F.lit("High")}
    )
    df = contrib.with_ranked_shares(contrib.with_contributions(df), name="s")
    lines = df.select(explanation("y", "lv", "s")).first()[0].split("\n")
    assert lines[0] == (
        "Your daily carbon footprint is estimated at 11.0 kg CO₂, which is classified as "
        "**High** impact."
    )
    assert lines[1].startswith("This is above average.")
    assert lines[2] == "" and lines[3].startswith("The main contributor to your footprint is **energy**")
    assert lines[4].startswith("Followed by **transport**")
    assert lines[6] == "**Key observations:**" and len(lines) == 11
    text = df.select(service_explanation("y", "lv", "s")).first()[0]
    assert text.startswith("Your predicted carbon footprint is 11.0 kg CO₂ per day")
    assert "'energy'" in text and text.count("Note: ") == 3


def test_plausibility(records, sample):
    odd = {**sample, "transport_mode": "Walk", "distance_km": 120, "renewable_usage_pct": 110,
           "eco_actions": -1}
    df = records(sample, odd).withColumns(
        {"carbon_footprint_kg": F.lit(25.0), "carbon_impact_level": F.lit("Low")}
    )
    good, bad = [r["v"] for r in df.orderBy("index").select("index", plausibility().alias("v")).collect()]
    assert good["is_valid"] and good["errors"] == []
    assert good["warnings"] == [
        "Carbon footprint (25.00 kg) outside typical range (1.0-20.0 kg)",
        "Impact level 'Low' doesn't match expected level 'High' for footprint 25.00 kg",
    ]
    assert not bad["is_valid"]
    assert bad["errors"] == ["Renewable usage (110.0%) cannot exceed 100%",
                             "Eco actions (-1) cannot be negative"]
    assert "Walking distance (120.0 km) seems unusually high" in bad["warnings"]
    assert "distance_km (120.0) seems unusually high" in bad["warnings"]


def test_vote_ties_take_the_first_class(spark):
    df = spark.createDataFrame([("High", "Low"), ("High", "Medium"), ("High", "High")], "a string, b string")
    votes = [r[0] for r in df.select(ensemble.vote_majority([F.col("a"), F.col("b")])).collect()]
    assert votes == ["Low", "Medium", "High"]
    with pytest.raises(ValueError, match="Unknown ensemble type: stacking"):
        ensemble.check_ensemble_type("stacking")


def test_engineered_features(records, sample):
    rows = engineer_features(records(sample, {**sample, "distance_km": 31, "day_type": "Weekend"}))
    first, second = rows.orderBy("index").collect()
    assert first["transport_impact_score"] == 15.5
    assert first["energy_efficiency"] == pytest.approx(6.15)
    assert first["waste_per_activity"] == pytest.approx(0.25)
    assert first["sustainability_score"] == pytest.approx((0.25 + 0.4 + 0.5 + 0.5) / 4)
    assert (first["is_weekend"], second["is_weekend"]) == (0, 1)
    # A frame without any travel has no largest score to compare with.
    still = engineer_features(records({**sample, "distance_km": 0})).first()
    assert still["sustainability_score"] is None
