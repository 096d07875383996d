"""Folders whose content appears at once: complete parts, made visible by a pointer written last.

``<folder>/parts/<part>`` holds data that its writer has finished; an empty file ``<folder>/published/<number>-<part>``
makes the part visible. Creating an empty file is atomic in every store Spark writes to, so a reader sees a part whole
or not at all, and a writer that dies leaves at most a part that nothing points to. Nothing is changed in place.
"""

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_part() -> str:
    """Name of a part to be written; ``part_path`` says where."""
    return uuid.uuid4().hex


def part_path(folder: str, part: str) -> str:
    return f"{folder.rstrip('/')}/parts/{part}"


def published(spark: SparkSession, folder: str) -> list[str]:
    """Visible parts, the oldest first. A part may be published again and then stands last as well."""
    path, fs = _path(spark, f"{folder.rstrip('/')}/published")
    if not fs.exists(path):
        return []
    # One name for each publication.
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return [n.split("-", 1)[1] for n in names]


def publish(spark: SparkSession, folder: str, part: str) -> None:
    """Make a finished part visible. Of two at the same moment both stay visible, in the order of their names."""
    path, fs = _path(spark, part_path(folder, part))
    if not fs.exists(path):
        raise FileNotFoundError(f"No such part: {part}")
    number = len(published(spark, folder)) + 1
    mark, _ = _path(spark, f"{folder.rstrip('/')}/published/{number:010d}-{part}")
    fs.create(mark, True).close()
