"""Reading and writing activity files with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dayprint.constants import FEATURES
from dayprint.functions.validation import coerce_numeric
from dayprint.schema import ACTIVITY_SCHEMA, FEATURE_SCHEMA, RAW_FEATURE_SCHEMA

CORRUPT = "_corrupt_record"


def read_activity(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType = ACTIVITY_SCHEMA,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read activity records from csv (with header), json or parquet.

    Unreadable cells and NaN become null: both mean missing. With ``keep_corrupt`` the text of a broken
    csv or json line is kept in ``_corrupt_record``.
    """
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json") and keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        # A header that disagrees with the schema fails the read.
        reader = reader.option("header", True).option("enforceSchema", False)
    return nan_as_null(reader.schema(schema).option("mode", "PERMISSIVE").load(path))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN of all fractional columns as null."""
    fractional = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractional})


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read csv files as text columns named by their header, whatever they are.

    All files of a folder must have the same header; another order or another
    name fails the read instead of mixing up columns.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    schema = reader.csv(path).schema
    return require_columns(reader.schema(schema).option("enforceSchema", False).csv(path))


def missing_columns(columns: list[str]) -> list[str]:
    return [c for c in FEATURES if c not in columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Fail while planning, before any data is read, if a column is absent."""
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError(f"Missing columns in CSV: {missing}")
    return df


def column_presence(records: DataFrame, column: str = "record") -> DataFrame:
    """How many JSON records carry each required field.

    Counts are combined before the shuffle, so only one row per distinct field
    name and task moves. A field that no record carries is missing.
    """
    required = records.sparkSession.createDataFrame(
        list(enumerate(FEATURES)), "position int, column_name string"
    )
    present = (
        records.select(F.explode(F.json_object_keys(column)).alias("column_name"))
        .where(F.col("column_name").isin(FEATURES))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("present_rows"))
    )
    # Both sides hold at most one row per required field.
    return required.join(F.broadcast(present), "column_name", "left").select(
        "position",
        "column_name",
        F.coalesce("present_rows", F.lit(0)).alias("present_rows"),
        F.col("present_rows").isNull().alias("is_missing"),
    )


def records_to_frame(records: DataFrame, column: str = "record") -> DataFrame:
    """Parse JSON records into the fixed, typed feature columns."""
    parsed = records.withColumn(column, F.from_json(column, RAW_FEATURE_SCHEMA))
    others = [c for c in records.columns if c != column]
    return coerce_numeric(parsed.select(*others, *[f"{column}.{c}" for c in FEATURES]))


def rows_to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few records given as dicts; absent fields become null.

    For requests and tests. Bulk data is read from files instead.
    """
    text = [tuple(None if r.get(c) is None else str(r[c]) for c in FEATURES) for r in rows]
    indexed = [(i, *t) for i, t in enumerate(text)]
    schema = T.StructType([T.StructField("index", T.LongType())] + RAW_FEATURE_SCHEMA.fields)
    frame = coerce_numeric(spark.createDataFrame(indexed, schema))
    # Whole numbers of actions stay integers, as in files.
    return frame.withColumn("eco_actions", typed_eco_actions())


def typed_eco_actions():
    return F.col("eco_actions").try_cast(FEATURE_SCHEMA["eco_actions"].dataType)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since csv cells are flat."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write scored records; csv gets a header and JSON text for nested columns."""
    if fmt == "csv":
        flatten_for_csv(df).write.mode("overwrite").option("header", True).option(
            "escape", '"'
        ).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
