"""Activity records derived from an ``events`` table.

Each event gives one record: the event type stands for the transport mode, its
value for the distance and the number in its properties for the renewable
share; the other fields and the noise follow from the event id.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dayprint.constants import FEATURES, FOOD_WEIGHTS, FOOTPRINT, LEVEL, TRANSPORT_WEIGHTS
from dayprint.functions.features import impact_level, lookup_sql

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Transport mode that stands for each event type.
MODE_OF_EVENT = {"view": "Walk", "click": "Bike", "signup": "Bus", "error": "EV"}


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{folder}/events.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """Activity records with their footprint and level; a narrow projection."""
    modes = " ".join(f"when '{e}' then '{m}'" for e, m in MODE_OF_EVENT.items())
    inputs = events.selectExpr(
        "event_id as record_id",
        "user_id",
        "cast(ts as date) as activity_date",
        "if(dayofweek(cast(ts as date)) in (1, 7), 'Weekend', 'Weekday') as day_type",
        f"case event_type {modes} else 'Car' end as transport_mode",
        "least(round(value / 5.0D, 2), 98.0D) as distance_km",
        "2.0D + (event_id * 37) % 181 / 10.0D as electricity_kwh",
        "double(int(regexp_extract(props, '([0-9]+)', 1))) as renewable_usage_pct",
        "element_at(array('Veg', 'Mixed', 'Non-Veg'), int((event_id * 31) % 97 % 3) + 1) as food_type",
        "(event_id * 13) % 121 / 10.0D as screen_time_hours",
        "0.1D + (event_id * 7) % 19 / 10.0D as waste_generated_kg",
        "int((event_id * 17) % 89 % 6) as eco_actions",
        "((event_id * 101) % 211 - 105) / 70.0D as noise",
    )
    footprint = f"""3.500013D
        + {lookup_sql('transport_mode', TRANSPORT_WEIGHTS)} * distance_km * 0.12D
        + electricity_kwh * (100 - renewable_usage_pct) / 100 * 0.35D
        + {lookup_sql('food_type', FOOD_WEIGHTS)} * 2
        + waste_generated_kg * 0.8D + screen_time_hours * 0.1D - eco_actions * 0.15D + noise"""
    return inputs.withColumn(FOOTPRINT, F.expr(f"round({footprint}, 4)")).select(
        *[c for c in inputs.columns if c != "noise"],
        FOOTPRINT,
        impact_level(FOOTPRINT).alias(LEVEL),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return from_events(read_events(spark, folder))


def activity_raw(spark: SparkSession, folder: str, keep: list[str] = []) -> DataFrame:
    """The same records as text, with missing, unknown and impossible values.

    ``keep`` names further columns of the clean record to carry along.
    """
    dirty = {
        "day_type": "when record_id % 41 = 3 then 'Holiday' when record_id % 43 = 5 then null",
        "transport_mode": "when record_id % 37 = 2 then 'Rocket'",
        "distance_km": "when record_id % 29 = 1 then '150.0' when record_id % 31 = 7 then 'invalid'",
        "electricity_kwh": "when record_id % 47 = 9 then '-5.0' when record_id % 53 = 11 then null",
        "screen_time_hours": "when record_id % 59 = 13 then '25.0'",
        "eco_actions": "when record_id % 61 = 17 then '15'",
    }
    columns = [
        f"case {dirty[c]} else string({c}) end as {c}" if c in dirty else f"string({c}) as {c}"
        for c in FEATURES
    ]
    return activity(spark, folder).selectExpr("record_id", "user_id", *keep, *columns)
