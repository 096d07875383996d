"""Readers of long rows hold a few of them at a time, however many their partition has."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dayprint.llm import class_ngrams, store

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_end_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int32())]))

    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    former = spark.conf.get(BATCH, None)
    with store.batches_of(spark, 1_000_000):
        found = [r["n"] for r in rows.mapInArrow(sizes, "n int").collect()]
    assert sum(found) == 40 and max(found) <= 12
    assert spark.conf.get(BATCH, None) == former
    with pytest.raises(ZeroDivisionError), store.batches_of(spark, 1_000_000):
        raise ZeroDivisionError
    assert spark.conf.get(BATCH, None) == former


def test_row_groups_of_long_rows_are_small(spark):
    rows = spark.range(60).coalesce(1).select("id", F.expr("array_join(transform(sequence(1, 3000), i -> uuid()), '')").alias("text"))
    table = store.stored(rows, "long", group_bytes=1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    assert sum(m.num_row_groups for m in groups) >= 4
    assert table.count() == 60


def test_the_model_reads_its_shards_in_small_batches(spark, monkeypatch):
    """The shards of one task come to a worker a few at a time."""
    found = []
    whole = class_ngrams._scored_texts

    def seen(docs, folds, fold):
        found.append(spark.conf.get(BATCH))
        return whole(docs, folds, fold)

    monkeypatch.setattr(class_ngrams, "_scored_texts", seen)
    docs = spark.createDataFrame([(i, f"a b c{i % 7} a b") for i in range(300)], "doc_id long, text string")
    rows = class_ngrams.scored(docs).collect()
    assert len(rows) == 300 and found[0].rstrip("b") == str(class_ngrams.WIDE_BYTES)
