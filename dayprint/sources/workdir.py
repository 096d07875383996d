"""Shared scratch folders for models, checkpoints and intermediate tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local master may leave it unset (tests, trials); on a cluster a local folder would differ on every machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="dayprint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


# Folders made by this driver, for release().
_MADE: list[str] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; Spark creates it when writing."""
    path = f"{shared_root(spark).rstrip('/')}/dayprint/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all folders made so far; call it when the results that read them are written."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, purpose: str):
    """Cut lineage by writing a table that survives the loss of executors."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
