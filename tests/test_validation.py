import pytest
from pyspark.sql import functions as F

from dayprint.constants import DOMAINS, RANGES
from dayprint.functions.validation import first_error, validation_errors
from dayprint.operators.scoring import quarantine
from dayprint.schema import FEATURE_SCHEMA
from dayprint.sources import files


def errors_of(df):
    return [r["e"] for r in df.select(validation_errors().alias("e")).collect()]


# A value just outside each end of every range, and an unknown category of every domain.
CASES = [
    (field, value, f"{field} must be between {lo:g} and {hi:g}")
    for field, (lo, hi) in RANGES.items()
    for value in ((lo - 1, hi + 1) if field == "eco_actions" else (lo - 0.001, hi + 0.001))
] + [
    (field, f"no {known[0]}", f"{field} must be one of: {list(known)}") for field, known in DOMAINS.items()
]


def test_each_invalid_value_gives_its_message(records, sample):
    df = records(*[{**sample, field: value} for field, value, _ in CASES])
    assert errors_of(df.orderBy("index")) == [[m] for _, _, m in CASES]
    firsts = df.orderBy("index").select(first_error().alias("e")).collect()
    assert [r["e"] for r in firsts] == [m for _, _, m in CASES]


def test_edges_are_valid(records, sample):
    lowest = {**sample, "distance_km": 0, "electricity_kwh": 0, "renewable_usage_pct": 0,
              "screen_time_hours": 0, "waste_generated_kg": 0, "eco_actions": 0}
    highest = {**sample, "distance_km": 100, "electricity_kwh": 50, "renewable_usage_pct": 100,
               "screen_time_hours": 24, "waste_generated_kg": 10, "eco_actions": 10}
    assert errors_of(records(sample, lowest, highest)) == [[], [], []]


def test_missing_fields_hide_later_checks(records, sample):
    partial = {"transport_mode": "Rocket", "distance_km": 15.5}
    found = errors_of(records(partial))[0]
    assert found[0] == "Missing required field: day_type"
    assert len(found) == 7 and all(m.startswith("Missing") for m in found)
    no_power = {k: v for k, v in sample.items() if k != "electricity_kwh"}
    assert errors_of(records(no_power)) == [["Missing required field: electricity_kwh"]]


def test_all_errors_in_order(records, sample):
    bad = {**sample, "food_type": "x", "day_type": "y", "eco_actions": 11, "distance_km": 101}
    assert [m.split()[0] for m in errors_of(records(bad))[0]] == [
        "day_type", "food_type", "distance_km", "eco_actions",
    ]


def test_text_numbers_and_nan_become_null(records, sample):
    row = records({**sample, "distance_km": "invalid", "waste_generated_kg": "NaN"}).first()
    assert row["distance_km"] is None and row["waste_generated_kg"] is None
    assert row["electricity_kwh"] == 8.2


def test_quarantine_keeps_every_row(records, sample):
    bad = {**sample, "distance_km": 150, "eco_actions": 12}
    rows = quarantine(records(sample, bad, sample)).orderBy("index").collect()
    assert [r["is_valid"] for r in rows] == [True, False, True]
    assert rows[1]["error"] == (
        "Validation failed: distance_km must be between 0 and 100, "
        "eco_actions must be between 0 and 10"
    )
    assert rows[1]["carbon_impact_level"] == "Error"
    assert rows[1]["carbon_footprint_kg"] is None
    service = quarantine(records(bad), "service").first()
    assert service["error"] == "distance_km must be between 0 and 100"
    with pytest.raises(ValueError):
        quarantine(records(bad), "other")


def test_required_columns_fail_while_planning(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    (tmp_path / "rows.csv").write_text("day_type,food_type\nWeekday,Veg\n")
    with pytest.raises(ValueError, match=r"Missing columns in CSV: \['transport_mode', 'dist"):
        files.read_raw_csv(spark, path)


def test_csv_types_and_corrupt_cells(spark, tmp_path):
    header = ",".join(FEATURE_SCHEMA.names)
    (tmp_path / "rows.csv").write_text(
        f"{header}\nWeekday,Car,15.5,8.2,25.0,Mixed,6.5,0.75,2\n"
        "Weekend,Bike,far,3.5,80.0,Veg,3.0,0.3,5\n"
    )
    df = files.read_activity(spark, str(tmp_path / "rows.csv"), schema=FEATURE_SCHEMA)
    rows = df.orderBy("eco_actions").collect()
    assert rows[0]["distance_km"] == 15.5 and rows[1]["distance_km"] is None
    assert rows[1]["electricity_kwh"] == 3.5
    kept = files.read_activity(
        spark, str(tmp_path / "rows.csv"), schema=FEATURE_SCHEMA, keep_corrupt=True
    ).cache()
    broken = [r[files.CORRUPT] for r in kept.collect() if r[files.CORRUPT]]
    assert broken == ["Weekend,Bike,far,3.5,80.0,Veg,3.0,0.3,5"]


def test_scored_csv_round_trip(spark, records, sample, tmp_path):
    df = records(sample).select("index", F.array(F.lit("a")).alias("tags"), F.lit('x"y').alias("t"))
    files.write_scored(df, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.first().asDict() == {"index": "0", "tags": '["a"]', "t": 'x"y'}


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_nan_is_missing_in_every_format(spark, tmp_path, fmt):
    rows = [(float(v), "Car") for v in ("1", "NaN", "2", "nan", "6")]
    wide = spark.createDataFrame(rows, "distance_km double, transport_mode string")
    for c in FEATURE_SCHEMA.names:
        if c not in wide.columns:
            wide = wide.withColumn(c, F.lit(None).cast(FEATURE_SCHEMA[c].dataType))
    path = str(tmp_path / fmt)
    wide.select(FEATURE_SCHEMA.names).write.format(fmt).option("header", True).save(path)
    df = files.read_activity(spark, path, fmt, FEATURE_SCHEMA)
    r = df.agg(F.count("distance_km"), F.avg("distance_km"), F.median("distance_km")).first()
    assert tuple(r) == (3, 3.0, 2.0)


def test_headers_in_another_order_fail(spark, tmp_path):
    names = list(FEATURE_SCHEMA.names)
    other = names[:-2] + [names[-1], names[-2]]
    for i, header in enumerate((names, other)):
        (tmp_path / f"{i}.csv").write_text(",".join(header) + "\n" + ",".join("1" * len(header)) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_raw_csv(spark, str(tmp_path)).collect()


def test_first_messages_as_published(records, sample):
    # Fixed texts, written out once.
    bad = [{**sample, "day_type": "Someday"}, {**sample, "distance_km": 100.5}, {**sample, "eco_actions": 11}]
    firsts = [r["e"] for r in records(*bad).orderBy("index").select(first_error().alias("e")).collect()]
    assert firsts == [
        "day_type must be one of: ['Weekday', 'Weekend']",
        "distance_km must be between 0 and 100",
        "eco_actions must be between 0 and 10",
    ]
