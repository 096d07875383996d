"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from dayprint.sources.workdir import new_folder

#: A side of a join is broadcast only after its size was counted and found to be at most this.
BROADCAST_BYTES = 32 << 20


def stored(df: DataFrame, purpose: str, codec: str = "zstd", group_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    Tables of rows of megabytes give `group_bytes`, because their readers hold a row group at once.
    """
    path = new_folder(df.sparkSession, purpose)
    writer = df.write.option("compression", codec)
    if group_bytes:
        # the writer looks at its size after that many rows only
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of intermediate tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """The stored table, marked for broadcast if its counted rows fit; larger ones are joined by a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about `most` bytes in the queries that run meanwhile, not only of so many rows.

    A batch of long rows would else hold all rows of its partition, once in the JVM and once in the worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    former = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, former)
