"""Batch scoring: one plan from raw rows to scored rows, errors kept."""

import json
from collections.abc import Callable
from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dayprint.constants import ERROR_LEVEL, FEATURES, FOOTPRINT, LEVEL, LEVELS
from dayprint.functions.confidence import (
    class_confidence,
    input_summary,
    overall_confidence,
    regression_confidence,
)
from dayprint.functions.contributions import (
    as_map,
    service_contributions,
    with_contributions,
)
from dayprint.functions.plausibility import plausibility
from dayprint.functions.suggestions import suggestions
from dayprint.functions.validation import first_error, validation_errors
from dayprint.sources.published import new_part, part_path, publish, published
from dayprint.sources.workdir import materialise

# A scorer adds ``carbon_footprint_kg``, ``carbon_impact_level`` and
# ``class_probabilities`` (array in LEVELS order, or null) to valid records.
Scorer = Callable[[DataFrame], DataFrame]


def quarantine(df: DataFrame, variant: str = "core") -> DataFrame:
    """Mark invalid records in one pass.

    core: ``error`` is "Validation failed: " and all messages. service: the
    first message only. The footprint of an invalid record is null and its
    level is ``Error``; valid rows get null in these columns.
    """
    if variant == "core":
        checked = df.withColumn("errors", validation_errors())
        error = F.when(
            F.size("errors") > 0,
            F.concat(F.lit("Validation failed: "), F.concat_ws(", ", "errors")),
        )
    elif variant == "service":
        checked = df
        error = first_error()
    else:
        raise ValueError(f"Unknown variant: {variant}")
    return (
        checked.withColumn("error", error)
        .withColumn("is_valid", F.col("error").isNull())
        .withColumn(
            LEVEL, F.when(F.col("error").isNotNull(), ERROR_LEVEL).cast("string")
        )
        .withColumn(FOOTPRINT, F.lit(None).cast("double"))
    )


def probability_map(probabilities: Column, level: Column) -> Column:
    """Level to probability; without probabilities the level itself gets 1."""
    labels = F.array(*[F.lit(v) for v in LEVELS])
    return F.coalesce(
        F.map_from_arrays(labels, probabilities), F.create_map(level, F.lit(1.0))
    )


def decorate(
    scored: DataFrame, stats: dict | None, timestamp: Column | None = None, variant: str = "core"
) -> DataFrame:
    """Confidence, suggestions, contributions and summary of scored records."""
    footprint, level = F.col(FOOTPRINT), F.col(LEVEL)
    probs = F.col("class_probabilities")
    when = F.current_timestamp() if timestamp is None else timestamp
    scored = scored.withColumn("classification_confidence", class_confidence(probs))
    if variant == "core":
        scored = scored.withColumn("regression_confidence", regression_confidence(footprint, stats))
        confidence = overall_confidence(
            F.col("regression_confidence"), F.col("classification_confidence")
        )
        scored = with_contributions(scored, "feature_contributions")
    else:
        confidence = F.col("classification_confidence")
        scored = scored.withColumn("feature_contributions", service_contributions())
    return scored.withColumns(
        {
            "confidence": confidence,
            "probabilities": probability_map(probs, level),
            "suggestions": suggestions(LEVEL, variant),
            "feature_contributions": as_map(F.col("feature_contributions")),
            "timestamp": F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "input_summary": input_summary(),
        }
    ).drop("class_probabilities")


def score_batch(
    df: DataFrame,
    scorer: Scorer,
    stats: dict | None = None,
    timestamp: Column | None = None,
    variant: str = "core",
) -> DataFrame:
    """Validate, score and explain every record; invalid ones carry an error.

    One output row per input row, told apart by the caller's own key columns.
    The input is read once: the fields of invalid records are blanked while
    scoring, so they cannot fail it, and are put back next to the error.
    """
    checked = quarantine(df, variant).drop("errors", FOOTPRINT, LEVEL)
    ok = F.col("is_valid")
    blanked = checked.withColumn("original", F.struct(*FEATURES)).withColumns(
        {c: F.when(ok, F.col(c)) for c in FEATURES}
    )
    scored = decorate(scorer(blanked), stats, timestamp, variant)
    added = [c for c in scored.columns if c not in blanked.columns]
    kept = {c: F.when(ok, F.col(c)) for c in added}
    kept[LEVEL] = kept[LEVEL].otherwise(ERROR_LEVEL)
    if variant == "service":
        kept["confidence"] = kept["confidence"].otherwise(0.0)
        kept["suggestions"] = kept["suggestions"].otherwise(
            F.slice("suggestions", 1, 0)
        )
    restored = {c: F.col(f"original.{c}") for c in FEATURES}
    return scored.withColumns({**kept, **restored}).drop("original", "is_valid")


# A key with at least this share of all rows is hot; there are at most 1/share.
HOT_SHARE = 0.001


def _keyed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``input_key``, and the distinct inputs with their ``repeats``."""
    # Adding zero turns -0.0 into 0.0, as grouping does.
    same = {f.name: F.col(f.name) + F.lit(0.0).cast(f.dataType) for f in df.select(*columns).schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    fields = F.struct(*[same.get(c, F.col(c)).alias(c) for c in columns])
    key = F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)
    keyed = df.withColumn("input_key", key)
    distinct_inputs = keyed.groupBy("input_key").agg(
        F.count(F.lit(1)).alias("repeats"), F.first(fields).alias("fields")
    ).select("input_key", "repeats", "fields.*")
    return keyed, distinct_inputs


def _handed_out(keyed: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every row with the stored output of its input; those of hot inputs are broadcast."""
    total = outputs.agg(F.sum("repeats")).first()[0] or 0
    is_hot = F.col("repeats") >= total * HOT_SHARE
    hot = F.broadcast(outputs.where(is_hot).drop("repeats"))
    cold = outputs.where(~is_hot).drop("repeats")
    cold_rows = keyed.join(hot.select("input_key"), "input_key", "left_anti")
    return (
        keyed.join(hot, "input_key")
        .unionByName(cold_rows.join(cold, "input_key"))
        .drop("input_key")
    )


def score_distinct(df: DataFrame, scorer: Scorer, columns: list[str] = FEATURES) -> DataFrame:
    """Score equal inputs once and hand the result to all their rows.

    Inputs are compared by a hash of all fields, where null equals null, NaN
    equals NaN and -0.0 equals 0.0. Every distinct input is scored once and
    stored. The results of hot inputs, at most ``1 / HOT_SHARE`` of them, are
    broadcast; only the rows of the other inputs are shuffled to meet their
    result, so a pattern that many rows share does not pile up in one task.
    """
    keyed, distinct_inputs = _keyed(df, columns)
    outputs = materialise(scorer(distinct_inputs).drop(*columns), "scored-inputs")
    return _handed_out(keyed, outputs)


class ResultCache:
    """Outputs of inputs scored before, kept from batch to batch in a shared folder.

    The cache of one model version is a row per input key: its outputs and its
    bucket, a number from the key. A batch reads the buckets that its own keys
    fall into, scores only what is not there, and publishes the new outputs as
    one part when they are completely written; a batch that fails leaves
    nothing visible. Two batches that run side by side may both score an input;
    readers take one of its rows. Another version (or other columns) has a
    cache of its own, so a new model never meets old results.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, version: str, columns: list[str] = FEATURES):
        self.spark, self.columns = spark, columns
        self.folder = f"{folder.rstrip('/')}/{version}-{md5(json.dumps(columns).encode()).hexdigest()[:12]}"

    def entries(self) -> DataFrame | None:
        """All visible rows, or None while there are none."""
        parts = list(dict.fromkeys(published(self.spark, self.folder)))
        if not parts:
            return None
        # A compacted part stands for all parts that were published before it.
        whole = [i for i, p in enumerate(parts) if p.endswith("-all")]
        paths = [part_path(self.folder, p) for p in parts[whole[-1] if whole else 0 :]]
        parsed = [self.spark.read.parquet(p) for p in paths]
        return reduce(lambda a, b: a.unionByName(b), parsed)

    def _write(self, rows: DataFrame, part: str) -> None:
        # A bucket's rows go to few files; a key is one row, so no bucket is hot.
        rows.repartition("bucket").write.partitionBy("bucket").parquet(part_path(self.folder, part))
        publish(self.spark, self.folder, part)

    def _once(self, rows: DataFrame) -> DataFrame:
        outputs = [c for c in rows.columns if c not in ("input_key", "bucket")]
        one = rows.groupBy("input_key", "bucket").agg(F.first(F.struct(*outputs)).alias("o"))
        return one.select("input_key", "bucket", "o.*")

    def compact(self) -> None:
        """One part instead of many; run it when no batch is being scored."""
        entries = self.entries()
        if entries is not None:
            self._write(self._once(entries), new_part() + "-all")

    def score(self, df: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
        """Scored rows, and one row of figures: rows, distinct_inputs, hits, misses, hit_rate (of distinct inputs)."""
        keyed, inputs = _keyed(df, self.columns)
        bucket = F.pmod(F.xxhash64("input_key"), F.lit(self.BUCKETS)).cast("int")
        inputs = materialise(inputs.withColumn("bucket", bucket), "inputs")
        known = self.entries()
        if known is None:
            missing, found = inputs, None
        else:
            # At most BUCKETS numbers; the other buckets' files are not opened.
            touched = [r["bucket"] for r in inputs.select("bucket").distinct().collect()]
            near = known.where(F.col("bucket").isin(touched))
            wanted = inputs.select("input_key", "repeats")
            found = materialise(self._once(near.join(wanted.select("input_key"), "input_key", "left_semi")).join(wanted, "input_key"), "cache-hits")
            missing = inputs.join(found.select("input_key"), "input_key", "left_anti")
        fresh = materialise(scorer(missing).drop(*self.columns), "cache-misses")
        if not fresh.isEmpty():
            self._write(fresh.drop("repeats"), new_part())
        outputs = fresh if found is None else fresh.unionByName(found)
        hits = F.lit(0).cast("long") if found is None else found.agg(F.count(F.lit(1))).scalar()
        figures = inputs.agg(
            F.coalesce(F.sum("repeats"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_inputs")
        ).withColumn("hits", hits)
        figures = figures.withColumn("misses", F.col("distinct_inputs") - F.col("hits")).withColumn(
            "hit_rate", F.coalesce(F.try_divide(F.col("hits").cast("double"), "distinct_inputs"), F.lit(0.0))
        )
        return _handed_out(keyed, outputs.drop("bucket")), figures


def repeat_statistics(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Rows, distinct inputs, repeats and their share."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_inputs"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"),
        F.coalesce(
            F.try_divide(F.sum(F.col("n") - 1).cast("double"), F.sum("n")), F.lit(0.0)
        ).alias("hit_rate"),
    )


def with_plausibility(scored: DataFrame) -> DataFrame:
    """Add the plausibility block to scored records."""
    return scored.withColumn("validation", plausibility())
