"""Continuous scoring of arriving files with Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dayprint.constants import LEVEL


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "json",
    pattern: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Files of a fixed schema as an unbounded table."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def score_stream(
    records: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score each record as it arrives and append it to a parquet table.

    Scoring keeps no state, so there is nothing to expire and late records
    need no watermark. The checkpoint and the sink's log make every record
    appear once, also after a restart with the same ``checkpoint``, a folder
    that outlives the job.
    """
    writer = (
        score(records)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)


def score_stream_once(
    records: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    folder: str,
    key: str,
    event_time: str,
    delay: str = "7 days",
    available_now: bool = True,
) -> StreamingQuery:
    """Score each record id once, however often it arrives, and keep running level counts.

    Ids are keyed state that lives for ``delay`` of event time beyond the
    record: a replay within it is dropped, also in another micro-batch or after
    a restart, and a record later than the watermark is dropped as too late.
    Records without a time have no place in the stream and are dropped, and of
    all records without an id one is kept. Micro-batch ``n`` owns
    ``rows/batch=n`` and ``counts/batch=n`` and overwrites them when it is run
    again, so a crash between the two loses and repeats nothing.
    """
    once = (
        records.where(F.col(event_time).isNotNull())
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark([key])
    )

    def write(batch: DataFrame, number: int) -> None:
        rows = f"{folder}/rows/batch={number}"
        scored = score(batch)
        scored.write.mode("overwrite").parquet(rows)
        kept = batch.sparkSession.read.schema(scored.schema).parquet(rows)
        kept.groupBy(LEVEL).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/counts/batch={number}"
        )

    writer = once.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def scored_once(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of ``score_stream_once`` with their micro-batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")


def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records per level after every micro-batch: batch, level, ``n`` in it and ``total`` so far.

    A row for each micro-batch and each level that has occurred in it.
    """
    rows = spark.read.schema(f"{LEVEL} string, n long, batch long").parquet(f"{folder}/counts")
    return rows.selectExpr(
        "batch",
        LEVEL,
        "n",
        # A few rows for each micro-batch.
        f"sum(n) over (partition by {LEVEL} order by batch) as total",
    )
