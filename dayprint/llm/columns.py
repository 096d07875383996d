"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between words: space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, and only when the result is needed."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def prefix_sums(values: Column) -> Column:
    """For each number of an array the sum of those before it, in two levels (n ** 1.5 steps)."""

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(
            xs,
            start,
            lambda a, x: F.struct((a["total"] + x).alias("total"), F.array_append(a["sums"], a["total"]).alias("sums")),
        )

    def two(xs: Column) -> Column:
        n = F.size(xs)
        width = F.ceil(F.sqrt(n)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: run(F.slice(xs, k * width + 1, width)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, run(F.transform(p, lambda x: x["total"]))["sums"], lambda x, o: F.transform(x["sums"], lambda s: s + o))))

    longs = F.transform(values, lambda x: x.cast("long"))
    return let(longs, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(two(xs)))
