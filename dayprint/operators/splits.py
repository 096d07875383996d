"""Reproducible train/test splits and cross-validation folds."""

from pyspark.sql import DataFrame, functions as F, types as T

from dayprint.constants import LEVEL, LEVELS
from dayprint.functions.text import text_list
from dayprint.operators.order_statistics import order_statistics, rank_targets
from dayprint.sources.workdir import materialise

SEED = 42
# 13 hexadecimal digits fill 52 bits, which a double holds exactly.
HASH_DIGITS = 13


def key_hash(key: str, seed: int = SEED) -> str:
    """SQL text of a hash that every engine computes alike."""
    return f"md5(concat(string({key}), ':{seed}'))"


def hash_number(digest: str) -> str:
    return f"bigint(conv(substr({digest}, 1, {HASH_DIGITS}), 16, 10))"


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Random split by a hash threshold: one pass, no shuffle.

    The share of test rows is ``test_size`` in expectation, in every stratum.
    """
    threshold = f"{round(test_size * 16**8):08x}"
    is_test = f"substr({key_hash(key, seed)}, 1, 8) < '{threshold}'"
    return df.withColumn("split", F.expr(f"if({is_test}, 'test', 'train')"))


def _known(per_stratum: DataFrame, stratum: str, strata: list[str]) -> DataFrame:
    """At most one row per known stratum, small enough to broadcast."""
    return per_stratum.where(f"{stratum} in ({text_list(strata)})")


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str = LEVEL,
    strata: list[str] = LEVELS,
    test_size: float = 0.2,
    seed: int = SEED,
    store_limits: bool = False,
) -> DataFrame:
    """Exact split: in every stratum ``round(n * test_size)`` rows are test rows.

    The test rows are those with the smallest key hashes. Only the hash of the
    last test row of each stratum is searched for, by counting, and then every
    row is compared with it; the records themselves are not shuffled. Rows with
    the same key stay on the same side, so with repeated keys the size is met as
    nearly as whole keys allow. Rows outside ``strata`` go to train.
    ``store_limits`` searches now and stores the hashes found, one row per
    stratum, so that reading the split again and again does not search again.
    """
    digest = key_hash(key, seed)
    hashed = df.selectExpr(
        stratum,
        f"{key} as key",
        f"{digest} as digest",
        f"{hash_number(digest)} as number",
    )
    size = f"bigint(round(n * {float(test_size)!r}D))"
    last_rank = f"filter(array({size} - 1), r -> r >= 0)"
    targets = _known(rank_targets(hashed, [stratum], "number", last_rank), stratum, strata)
    last = order_statistics(hashed, [stratum], "number", targets)
    # Different keys may share 52 bits: the full digest settles those few keys.
    ends = F.broadcast(last.selectExpr(f"{stratum} as end_stratum", "rank", "value"))
    at_end = hashed.join(ends, F.expr(f"{stratum} = end_stratum and number <= value"))
    tie = "case when number = value then struct(digest, key) end"
    counts = at_end.groupBy(stratum, "rank", F.expr(f"{tie} as tied")).agg(F.expr("count(1) as cnt"))
    running = counts.withColumn(
        "upto",
        F.expr(f"sum(cnt) over (partition by {stratum} order by tied nulls first)"),
    ).where("tied is not null and upto > rank")
    # The key that holds the last rank, and whether leaving it out comes nearer.
    cutoff = running.groupBy(stratum).agg(
        F.expr("min_by(tied, upto) as cutoff"),
        F.expr("min_by(upto - (rank + 1) > (rank + 1) - (upto - cnt), upto) as left_out"),
    ).withColumnRenamed(stratum, "cut_stratum")
    if store_limits:
        cutoff = materialise(cutoff, "split-limits")
    # One row per stratum of a closed domain.
    joined = df.join(F.broadcast(cutoff), F.expr(f"{stratum} = cut_stratum"), "left")
    mine = f"struct({digest} as digest, {key} as key)"
    is_test = f"coalesce({mine} < cutoff or ({mine} = cutoff and not left_out), false)"
    return joined.selectExpr(*df.columns, f"if({is_test}, 'test', 'train') as split")


def _ordered_key(df: DataFrame, key: str) -> str:
    """A number to lay rows out by: the key itself, or its hash when it is text."""
    kind = df.selectExpr(key).schema[0].dataType
    return key if isinstance(kind, T.NumericType) else hash_number(key_hash(key))


def _fold_from_ends(df: DataFrame, key: str, ends: DataFrame, match: str, folds: int) -> DataFrame:
    """Fold number = how many fold ends lie before the key.

    Rows without a key or of an unknown class are dealt out by a hash of their
    fields, so that every row is in one fold.
    """
    # One row per class, found once and read by every fold.
    ends = F.broadcast(materialise(ends, "fold-ends"))
    dealt = f"int(pmod(xxhash64({', '.join(df.columns)}), {folds}))"
    return df.join(ends, F.expr(match), "left").selectExpr(
        *df.columns,
        f"coalesce(if({key} is null, null, size(filter(ends, e -> e < {key}))), {dealt}) as fold",
    )


def _ends_at(found: DataFrame, targets: DataFrame, part: str) -> DataFrame:
    """Fold ends from ranks; a rank of -1 lies before every key."""
    at = found.groupBy(F.expr(f"{part} as at_part")).agg(
        F.expr("map_from_entries(collect_list(struct(rank, value))) as at")
    )
    # One row per part on both sides.
    return targets.join(F.broadcast(at), F.expr(f"{part} = at_part"), "left").selectExpr(
        f"{part} as end_part",
        "transform(end_ranks, r -> case when r < 0 then lo - 1 else at[r] end) as ends",
    )


_SEARCHED = "filter(array_distinct(end_ranks), r -> r >= 0)"


def contiguous_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Consecutive blocks in key order; the first ``n % folds`` get one more row."""
    ends = ", ".join(
        f"{i + 1} * (n div {folds}) + least({i + 1}, n % {folds}) - 1" for i in range(folds - 1)
    )
    key = _ordered_key(df, key)
    # Rows without a key have no place in the order.
    part = f"if({key} is null, 'none', 'all')"
    numbered = df.selectExpr(f"{part} as part", f"{key} as key")
    targets = rank_targets(numbered, ["part"], "key", f"array({ends})").withColumnRenamed(
        "ranks", "end_ranks"
    ).where("part = 'all'")
    wanted = targets.withColumn("ranks", F.expr(_SEARCHED)).drop("end_ranks")
    found = order_statistics(numbered, ["part"], "key", wanted)
    return _fold_from_ends(df, key, _ends_at(found, targets, "part"), f"{part} = end_part", folds)


def stratified_folds(
    df: DataFrame,
    key: str,
    stratum: str = LEVEL,
    strata: list[str] = LEVELS,
    folds: int = 5,
) -> DataFrame:
    """Blocks in key order inside each class, dealt so that folds stay balanced.

    Classes are laid end to end, in the order of their first key, and every
    ``folds``-th place of that line goes to the same fold; this gives the
    number of rows each fold takes from each class.
    """
    key = _ordered_key(df, key)
    known = df.selectExpr(stratum, f"{key} as key")
    sizes = rank_targets(known, [stratum], "key", "array()").drop("ranks")
    sizes = _known(sizes, stratum, strata)

    def upto(place: str, fold: int) -> str:
        """Places before ``place`` that go to this fold or to one before it."""
        return " + ".join(f"(({place}) + {folds - 1 - i}) div {folds}" for i in range(fold + 1))

    ends = ", ".join(f"{upto('start + n', i)} - ({upto('start', i)}) - 1" for i in range(folds - 1))
    # At most one row per class of a closed domain.
    targets = sizes.withColumn(
        "start",
        F.expr(
            """coalesce(sum(n) over (partition by 1 order by lo
                rows between unbounded preceding and 1 preceding), 0)"""
        ),
    ).withColumn("end_ranks", F.expr(f"array({ends})"))
    wanted = targets.withColumn("ranks", F.expr(_SEARCHED)).drop("start", "end_ranks")
    found = order_statistics(known, [stratum], "key", wanted)
    ends_by_class = _ends_at(found, targets, stratum)
    return _fold_from_ends(df, key, ends_by_class, f"{stratum} = end_part", folds)
