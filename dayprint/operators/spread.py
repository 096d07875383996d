"""Even work for all cores, whatever the files look like."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from dayprint.sources.workdir import materialise

#: Rows that one task of a fit takes at most.
ROWS_OF_A_FIT = 500_000


def spread(df: DataFrame, waves: int = 2) -> DataFrame:
    """``df`` dealt evenly to all cores, ``waves`` tasks for each.

    A Parquet file is read by row groups, so a million short records can arrive
    in a single task. Scoring, explaining and fitting cost far more a row than
    one shuffle of it.
    """
    return df.repartition(waves * df.sparkSession.sparkContext.defaultParallelism)


def spread_for_fit(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows dealt out for the many passes of a fit.

    Every task adds up the statistics of all nodes, so there are no more tasks
    than cores until their rows become many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_OF_A_FIT)))


def alike_together(encoded: DataFrame) -> DataFrame:
    """The encoded rows of each task in an order in which alike rows follow each other.

    A forest's nodes are far larger than a processor's cache. Rows in any order
    touch other nodes each, alike rows mostly those of the row before.
    """
    x = vector_to_array("features")
    # First the side of the mean and the categories, then cells of one deviation.
    return encoded.sortWithinPartitions(F.transform(x, lambda v: v > 0), F.transform(x, lambda v: F.floor(v)))


def stored(df: DataFrame) -> DataFrame:
    """``df`` dealt out and written once, for the many passes that learn from it.

    Learning an encoder, encoding and measuring each read the rows again; from
    one written row group each of these passes would run in a single task.
    """
    table = materialise(spread(df), "rows")
    # Files of one length are read in the order of their listing, which differs from run to run; a forest's draws follow the rows.
    files = sorted(table.inputFiles())
    return df.sparkSession.read.schema(table.schema).parquet(*files) if files else table
