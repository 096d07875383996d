"""Coercion and validation of activity records (null means missing)."""

from pyspark.sql import Column, DataFrame, functions as F

from dayprint.constants import DOMAINS, FEATURES, NUMERIC_FEATURES, RANGES
from dayprint.functions.text import array_of, quoted, text_list
from dayprint.schema import FEATURE_SCHEMA


def coerce_numeric(df: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Turn text numbers into doubles; anything unreadable becomes null."""
    return df.withColumns(
        {c: F.expr(f"nullif(try_cast({c} as double), double('NaN'))") for c in columns}
    )


def fill_missing_columns(df: DataFrame) -> DataFrame:
    """Add absent feature columns as typed nulls and fix the column order."""
    present = set(df.columns)
    extra = [c for c in df.columns if c not in FEATURES]
    typed = [
        f.name if f.name in present else f"cast(null as {f.dataType.simpleString()}) as {f.name}"
        for f in FEATURE_SCHEMA.fields
    ]
    return df.selectExpr(*extra, *typed)


def missing_field_errors() -> list[str]:
    return [
        f"case when {c} is null then {quoted(f'Missing required field: {c}')} end"
        for c in FEATURES
    ]


def domain_errors() -> list[str]:
    return [
        f"case when {c} not in ({text_list(allowed)}) "
        f"then {quoted(f'{c} must be one of: {allowed}')} end"
        for c, allowed in DOMAINS.items()
    ]


def range_errors() -> list[str]:
    return [
        f"case when {c} not between {lo} and {hi} "
        f"then {quoted(f'{c} must be between {lo} and {hi}')} end"
        for c, (lo, hi) in RANGES.items()
    ]


def validation_errors() -> Column:
    """All errors of a record; missing fields hide the later checks."""
    any_missing = " or ".join(f"{c} is null" for c in FEATURES)
    return F.expr(
        f"case when {any_missing} then {array_of(missing_field_errors())} "
        f"else {array_of(domain_errors() + range_errors())} end"
    )


def first_error() -> Column:
    """The first error only, or null for a valid record."""
    checks = missing_field_errors() + domain_errors() + range_errors()
    return F.expr(f"coalesce({', '.join(checks)})")
