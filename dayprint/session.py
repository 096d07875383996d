"""Spark settings that suit these jobs."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above this size; split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Records the Python line of every column call; costs driver time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str, master: str | None = None, extra: dict | None = None) -> SparkSession:
    """A session with these settings; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
