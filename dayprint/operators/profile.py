"""Profiles of activity tables and of scored batches."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayprint.constants import (
    DOMAINS,
    FEATURES,
    FOOTPRINT,
    LEVEL,
    LEVELS,
    NUMERIC_FEATURES,
)
from dayprint.functions.text import text_list
from dayprint.operators.order_statistics import exact_quantiles, long_numeric
from dayprint.operators.splits import HASH_DIGITS, hash_number, key_hash
from dayprint.sources.workdir import materialise

CORRELATED = NUMERIC_FEATURES + [FOOTPRINT]
CATEGORICALS = ["day_type", "transport_mode", "food_type", LEVEL]


def long_categories(df: DataFrame, columns: list[str], keep: list[str] = []) -> DataFrame:
    """One row per record and categorical column: ``variable``, ``category``."""
    pairs = ", ".join(f"'{c}', string({c})" for c in columns)
    return df.selectExpr(*keep, f"stack({len(columns)}, {pairs}) as (variable, category)")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "nulls")


def column_kinds(df: DataFrame) -> dict[str, str]:
    """``numeric`` or ``categorical`` for every column with such a type."""
    from pyspark.sql import types as T

    kinds = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            kinds[field.name] = "numeric"
        elif isinstance(field.dataType, T.StringType):
            kinds[field.name] = "categorical"
    return kinds


def describe(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    long = long_numeric(df, columns)
    moments = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(
        long, ["variable"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ).drop("n")
    # One row per column name on both sides.
    return moments.join(F.broadcast(quartiles), "variable")


def value_counts(df: DataFrame, columns: list[str] = CATEGORICALS) -> DataFrame:
    """Counts per distinct value of several columns in one aggregation."""
    return (
        long_categories(df, columns)
        .where(F.col("category").isNotNull())
        .groupBy("variable", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _pair_correlation(x: str, y: str) -> str:
    """Pearson correlation over the rows where both are known.

    Null for a constant column.
    """
    pair = f"double({x}), double({y})"
    return f"try_divide(regr_sxy({pair}), sqrt(regr_sxx({pair}) * regr_syy({pair})))"


def footprint_correlations(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """Correlation of each column with the footprint, largest size first."""
    row = df.agg(
        *[
            F.expr("1.0D" if c == FOOTPRINT else _pair_correlation(c, FOOTPRINT)).alias(c)
            for c in columns
        ]
    )
    return row.unpivot([], columns, "variable", "correlation").orderBy(
        F.abs("correlation").desc_nulls_last(), "variable"
    )


def correlation_matrix(df: DataFrame, columns: list[str] = CORRELATED) -> DataFrame:
    """All pairs from one pass: each pair once, then mirrored."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.expr(_pair_correlation(a, b)).alias(f"{a}_{b}") for a, b in pairs])
    cells = [(c, c, "1.0D") for c in columns]
    for a, b in pairs:
        cells += [(a, b, f"{a}_{b}"), (b, a, f"{a}_{b}")]
    structs = ", ".join(
        f"named_struct('x', '{x}', 'y', '{y}', 'correlation', {value})" for x, y, value in cells
    )
    return row.selectExpr(f"inline(array({structs}))")


def histogram(df: DataFrame, column: str = FOOTPRINT, bins: int = 30) -> DataFrame:
    """Equal bins from minimum to maximum; the last bin includes the maximum."""
    span = df.agg(
        F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    ).scalar()
    width = (span["hi"] - span["lo"]) / bins
    number = F.coalesce(
        F.least(F.floor(F.try_divide(F.col(column) - span["lo"], width)), F.lit(bins - 1)), F.lit(0)
    )
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (span["lo"] + F.col("bin") * width).alias("bin_start"),
            (span["lo"] + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )


def box_stats(
    df: DataFrame, columns: list[str] = ["transport_mode", "food_type", LEVEL], value: str = FOOTPRINT
) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outlier counts.

    Categories come in their fixed order (``position``).
    """
    domains = {**DOMAINS, LEVEL: LEVELS}
    pairs = ", ".join(f"'{c}', string({c})" for c in columns)
    long = df.selectExpr(value, f"stack({len(columns)}, {pairs}) as (variable, category)")
    keys = ["variable", "category"]
    position = " ".join(
        f"when '{c}' then array_position(array({text_list(domains[c])}), category)" for c in columns
    )
    quartiles = (
        exact_quantiles(
            long.where(f"case variable {position} end > 0"),
            keys,
            value,
            {"q1": 0.25, "median": 0.5, "q3": 0.75},
        )
        .withColumns(
            {
                "low_fence": F.expr("q1 - 1.5D * (q3 - q1)"),
                "high_fence": F.expr("q3 + 1.5D * (q3 - q1)"),
                "position": F.expr(f"int(case variable {position} end)"),
            }
        )
    )
    inside = f"{value} between low_fence and high_fence"
    # One row per known category.
    return (
        long.join(F.broadcast(quartiles), keys)
        .groupBy(*keys, *quartiles.columns[2:])
        .agg(
            F.expr(f"min(case when {inside} then {value} end)").alias("whisker_low"),
            F.expr(f"max(case when {inside} then {value} end)").alias("whisker_high"),
            F.expr(f"count_if(not {inside})").alias("outliers"),
        )
    )


def segment_means(df: DataFrame) -> DataFrame:
    """Mean footprint by mode, diet and day type, and renewables by level."""
    measures = {
        "transport_mode": FOOTPRINT,
        "food_type": FOOTPRINT,
        "day_type": FOOTPRINT,
        LEVEL: "renewable_usage_pct",
    }
    rows = ", ".join(f"'{c}', string({c}), '{m}', double({m})" for c, m in measures.items())
    return (
        df.selectExpr(
            f"stack({len(measures)}, {rows}) as (segment, category, measure, value)"
        )
        .groupBy("segment", "category", "measure")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    )


def scatter_grid(
    df: DataFrame, x: str = "renewable_usage_pct", y: str = FOOTPRINT, x_step: float = 5, y_step: float = 1
) -> DataFrame:
    """Every point of the scatter plot, counted on a grid."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            (F.floor(F.col(x) / x_step) * x_step).cast("double").alias("x"),
            (F.floor(F.col(y) / y_step) * y_step).cast("double").alias("y"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_sample(
    df: DataFrame,
    key: str,
    k: int,
    x: str = "renewable_usage_pct",
    y: str = FOOTPRINT,
    stratum: str = LEVEL,
) -> DataFrame:
    """Real points for a scatter plot: of each stratum the ``k`` rows with the least key hashes.

    Hashes are spread evenly, so a stratum of n rows has its k least ones below
    a share of k / n, and a margin of six deviations more, of their range. Only the
    few rows below that limit are ranked; the table is not sorted. A stratum where
    the limit turns out too low is taken whole. Rows without x or y are no points;
    rows with one key are ordered by x and y.
    """
    points = df.where(f"{x} is not null and {y} is not null").selectExpr(
        key, stratum, x, y, f"{key_hash(key)} as digest", f"{hash_number(key_hash(key))} / pow(16D, {HASH_DIGITS}) as place"
    )
    margin = f"({k} + 6 * sqrt({k}D) + 6)"
    sizes = points.groupBy(F.expr(f"{stratum} as of")).agg(F.count(F.lit(1)).alias("n"))
    # One row per stratum; strata are counted again below their limit.
    limits = F.broadcast(materialise(sizes.selectExpr("of", f"{margin} / n as most"), "limits"))
    near = points.join(limits, F.expr(f"{stratum} <=> of"))
    below = near.groupBy("of").agg(F.count_if(F.col("place") < F.col("most")).alias("found"))
    settled = limits.join(below.withColumnRenamed("of", "found_of"), F.expr("of <=> found_of"))
    settled = settled.selectExpr("of", f"if(found >= {k}, most, 2D) as most")
    order = Window.partitionBy(stratum).orderBy("digest", key, x, y)
    chosen = points.join(F.broadcast(settled), F.expr(f"{stratum} <=> of and place < most"))
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, stratum, x, y, "rank")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Long profile (section, name, value): size, target statistics, counts."""
    sizes = df.agg(
        F.count(F.lit(1)).cast("double").alias("n_samples"),
        F.lit(float(len(FEATURES))).alias("n_features"),
    ).unpivot([], ["n_samples", "n_features"], "name", "value")
    moments = describe(df, [FOOTPRINT]).unpivot(
        [], ["mean", "std", "min", "max", "median", "q1", "q3"], "name", "value"
    )
    counts = value_counts(df).select(
        F.col("variable").alias("section"),
        F.col("category").alias("name"),
        F.col("n").cast("double").alias("value"),
    )
    return (
        sizes.select(F.lit("size").alias("section"), "name", "value")
        .unionByName(moments.select(F.lit(FOOTPRINT).alias("section"), "name", "value"))
        .unionByName(counts)
    )


def target_stats(df: DataFrame) -> dict[str, Column]:
    """Training statistics that regression confidence needs, as subqueries."""
    s = df.agg(
        F.struct(
            F.avg(FOOTPRINT).alias("mean"),
            F.stddev_samp(FOOTPRINT).alias("std"),
            F.min(FOOTPRINT).alias("min"),
            F.max(FOOTPRINT).alias("max"),
        )
    ).scalar()
    return {k: s[k] for k in ("mean", "std", "min", "max")}


ERROR_TYPE = """case when lower(error) like '%validation%' then 'Validation Error'
    when lower(error) like '%model%' then 'Model Error' else 'Other Error' end"""


def error_types(scored: DataFrame) -> DataFrame:
    """Failures by the kind of their message."""
    return (
        scored.where("error is not null")
        .groupBy(F.expr(ERROR_TYPE).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stat_rows(row: DataFrame, section: str) -> DataFrame:
    names = row.columns
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [], names, "name", "value"
    ).select(F.lit(section).alias("section"), "name", "value")


def _medians(df: DataFrame, columns: list[str], quartiles: bool) -> DataFrame:
    wanted = {"median": 0.5, **({"q1": 0.25, "q3": 0.75} if quartiles else {})}
    return exact_quantiles(long_numeric(df, columns), ["variable"], "value", wanted)


def _long_rows(sections: dict[str, dict[str, str]]) -> str:
    """SQL that turns one row of figures into (section, name, value) rows."""
    rows = ", ".join(
        f"named_struct('section', '{section}', 'name', '{name}', 'value', double({value}))"
        for section, figures in sections.items()
        for name, value in figures.items()
    )
    return f"inline(array({rows}))"


def _group_rows(narrow: DataFrame, counts: str, shares: str) -> DataFrame:
    """Counts and percentages per level, and counts per error type.

    One scan gives the counts of all pairs of level and error type, which are
    a handful of rows; ``weight`` tells which rows count for a level.
    """
    pairs = narrow.groupBy(LEVEL, "error_type").agg(
        F.sum("weight").alias("weighted"), F.count(F.lit(1)).alias("rows")
    )
    sums = (
        pairs.selectExpr(f"stack(2, 'level', {LEVEL}, weighted, 'error', error_type, rows) as (kind, name, n)")
        .groupBy("kind", "name")
        .agg(F.sum("n").alias("n"))
        .withColumn("total", F.expr("sum(n) over (partition by kind)"))
        .where("name is not null and n > 0")
    )
    return sums.selectExpr(
        f"""inline(if(kind = 'error',
            array(named_struct('section', 'error_analysis', 'name', name, 'value', double(n))),
            array(named_struct('section', '{counts}', 'name', name, 'value', double(n)),
                  named_struct('section', '{shares}', 'name', name, 'value', n * 100 / total))))"""
    )


def analyze_predictions(scored: DataFrame) -> DataFrame:
    """Long report (section, name, value) over successes and failures.

    Deviation is of the population and level shares are of the successes. The
    scored rows are read several times, so hand over a stored table rather
    than a plan that scores again.
    """
    narrow = scored.selectExpr(
        LEVEL,
        "if(error is null, 1, 0) as weight",
        f"case when error is null then {FOOTPRINT} end as {FOOTPRINT}",
        "case when error is null then confidence end as confidence",
        f"case when error is not null then {ERROR_TYPE} end as error_type",
    )
    figures = {"rows": "count(1)", "good": "sum(weight)"}
    for c in (FOOTPRINT, "confidence"):
        for fn in ("avg", "stddev_pop", "min", "max"):
            figures[f"{fn}_{c}"] = f"{fn}({c})"
    overall = narrow.agg(*[F.expr(x).alias(name) for name, x in figures.items()]).selectExpr(
        _long_rows(
            {
                "totals": {
                    "total_predictions": "rows",
                    "successful_predictions": "coalesce(good, 0)",
                    "failed_predictions": "rows - coalesce(good, 0)",
                    "success_rate": "coalesce(try_divide(good * 100, rows), 0)",
                },
                "footprint_statistics": {
                    "mean": f"avg_{FOOTPRINT}",
                    "std": f"stddev_pop_{FOOTPRINT}",
                    "min": f"min_{FOOTPRINT}",
                    "max": f"max_{FOOTPRINT}",
                },
                "confidence_statistics": {
                    "mean": "avg_confidence",
                    "min": "min_confidence",
                    "max": "max_confidence",
                },
            }
        )
    )
    groups = _group_rows(narrow, "impact_level_distribution", "impact_level_percentages")
    middle = (
        _medians(narrow, [FOOTPRINT, "confidence"], quartiles=True)
        .unpivot(["variable"], ["median", "q1", "q3"], "name", "value")
        .where(f"variable = '{FOOTPRINT}' or name = 'median'")
        .selectExpr(
            f"if(variable = '{FOOTPRINT}', 'footprint_statistics', 'confidence_statistics') as section",
            "name",
            "value",
        )
    )
    return overall.where("value is not null").unionByName(middle).unionByName(groups)


def analyze_batch(scored: DataFrame) -> DataFrame:
    """Long report over all rows: sample deviation, shares of all rows."""
    narrow = scored.selectExpr(
        LEVEL, FOOTPRINT, "error", "1 as weight", "cast(null as string) as error_type"
    )
    figures = {
        "rows": "count(1)",
        "errors": "count(error)",
        "mean": f"avg({FOOTPRINT})",
        "std": f"stddev_samp({FOOTPRINT})",
        "min": f"min({FOOTPRINT})",
        "max": f"max({FOOTPRINT})",
    }
    overall = narrow.agg(*[F.expr(x).alias(name) for name, x in figures.items()]).selectExpr(
        _long_rows(
            {
                "totals": {
                    "total_samples": "rows",
                    "error_count": "errors",
                    "error_rate": "try_divide(errors * 100, rows)",
                },
                "footprint_stats": {c: c for c in ("mean", "std", "min", "max")},
            }
        )
    )
    middle = _medians(narrow, [FOOTPRINT], quartiles=False).selectExpr(
        "'footprint_stats' as section", "'median' as name", "median as value"
    )
    groups = _group_rows(narrow, "impact_distribution", "impact_percentages")
    return overall.unionByName(middle).unionByName(groups)


def prediction_statistics(scored: DataFrame) -> DataFrame:
    """One row: average, range, level shares, commonest mode, mean renewables."""
    modes = scored.where(F.col("transport_mode").isNotNull()).groupBy("transport_mode").agg(
        F.count(F.lit(1)).alias("n")
    )
    commonest = modes.orderBy(F.desc("n"), "transport_mode").limit(1).select("transport_mode")
    with_level = F.count(LEVEL)
    return scored.agg(
        F.avg(FOOTPRINT).alias("average_footprint"),
        F.min(FOOTPRINT).alias("footprint_min"),
        F.max(FOOTPRINT).alias("footprint_max"),
        *[
            F.try_divide(F.count_if(F.col(LEVEL) == name) * 100.0, with_level).alias(
                f"{name.lower()}_pct"
            )
            for name in LEVELS
        ],
        F.avg("renewable_usage_pct").alias("average_renewable_usage"),
    ).withColumn("most_common_transport", commonest.scalar())
