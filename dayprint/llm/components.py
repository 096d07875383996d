"""Connected components by large-star and small-star rounds; nothing is collected but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayprint.llm.store import dropped, stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each neighbour v of u with the least m of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b), component its least reachable node; loops are allowed.

    Each round halves the distance to the least node or better, so the rounds grow with the logarithm of a component's
    width. Every round is a written table.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        hooks = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = stored(hooks.where("u <> v").distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        dropped(edges.sparkSession, now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
