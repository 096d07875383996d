"""Exact order statistics and quantiles in two passes over the rows, without a global sort.

The first pass counts the rows of every key and summarises their values in a mergeable rank sketch (the summary behind
``percentile_approx``), which gives cut points with a known error in rank. Every wanted rank then lies in a bracket of a
few neighbouring cut points. The second pass counts the rows outside the brackets, and the rows of every value inside
them; about ``4 / STEPS`` of the rows lie inside for each wanted rank, and that tally is stored. All the rest happens on
the tally: the counts say which ranks each bracket really holds (if one missed its rank, the whole span of values is
tallied instead), and brackets with more than FEW rows are narrowed by rounds of BINS bins until a span holds one value
or at most FEW rows, which are ordered. Bins are equal on a logarithmic scale of both signs while a span covers more than
a factor of two, and equal in width below that, so at most six rounds are needed whatever the distribution.
"""

from pyspark.sql import DataFrame, functions as F

from dayprint.sources.workdir import materialise

BINS = 8192
# Rows of a span that may be ordered against each other.
FEW = 10_000
# Cut points of the sketch; its error in rank is half a step.
STEPS = 2000
_LARGEST = "1.7976931348623157E308D"
_GRID = "array(" + ", ".join(f"{i / STEPS!r}D" for i in range(STEPS + 1)) + ")"


def rank_targets(df: DataFrame, keys: list[str], value: str, ranks: str) -> DataFrame:
    """Value span, row count ``n``, cut points and wanted 0-based ``ranks`` per key.

    ``ranks`` is SQL text over ``n`` that gives an array of bigint. Null and
    NaN have no rank.
    """
    number = f"if(isnan({value}), null, {value})"
    return (
        df.groupBy(*keys)
        .agg(
            F.expr(f"min({number}) as lo"),
            F.expr(f"max({number}) as hi"),
            F.expr(f"count({number}) as n"),
            F.expr(f"percentile_approx({number}, {_GRID}, {2 * STEPS}) as cuts"),
        )
        .withColumn("ranks", F.expr(ranks))
    )


def _in_span(df: DataFrame, spans: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows inside a wanted span. Spans are few: keys times ranks."""
    renamed = [f"{k} as span_{k}" for k in keys]
    small = F.broadcast(spans.selectExpr(*renamed, "lo", "hi", "below", "n", "ranks"))
    match = " and ".join([f"{k} = span_{k}" for k in keys] + [f"{value} between lo and hi"])
    return df.join(small, F.expr(match))


def _keep_hit_bins(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Turn counts per bin into the spans that still hold a wanted rank."""
    part = ", ".join([*keys, "lo"])
    before = f"""sum(cnt) over (partition by {part} order by {order}
        rows between unbounded preceding and 1 preceding)"""
    return (
        counts.withColumn("start", F.expr(f"below + coalesce({before}, 0)"))
        .withColumn(
            "ranks", F.expr("filter(ranks, r -> r >= start and r < start + cnt)")
        )
        .where("size(ranks) > 0")
        .selectExpr(
            *keys, "bin_lo as lo", "bin_hi as hi", "start as below", "n", "ranks", "cnt"
        )
    )


MOST_SPANS = 100_000

# What belongs to a span travels as grouping columns: aggregating the array of
# ranks instead would make Spark sort every row.
_SPAN = ("lo", "below", "n", "ranks")


def _scale(x: str) -> str:
    """A logarithmic scale over all finite doubles, rising through zero."""
    return f"(signum({x}) * (ln(greatest(abs({x}), 4.9E-324D)) + 746))"


def _bin(value: str, bins: int) -> str:
    """Bin of a value within its span; infinities have bins of their own."""
    lo, hi = (f"greatest(least(double({c}), {_LARGEST}), -{_LARGEST})" for c in ("lo", "hi"))
    wide = f"({_scale(hi)} - {_scale(lo)} > 0.69)"
    share = f"""if({wide},
        try_divide({_scale(f"double({value})")} - {_scale(lo)}, {_scale(hi)} - {_scale(lo)}),
        try_divide({value} - {lo}, {hi} - {lo}))"""
    return f"""case when double({value}) = double('infinity') then {bins}
        when double({value}) = -double('infinity') then -1
        else coalesce(greatest(least(floor({share} * {bins}), {bins - 1}), 0), 0) end as bin"""


# Brackets of neighbouring cut points around the wanted ranks, joined where they meet: array of (lo, hi), rising. A rank's
# share of the rows is off by half a step at most in the sketch, so one step more on each side is room enough.
_NEAR = f"""transform(filter(ranks, r -> r >= 0 and r < n), r -> struct(
    cuts[int(greatest(floor(r / n * {STEPS}) - 1, 0))] as lo,
    cuts[int(least(ceil((r + 1) / n * {STEPS}) + 1, {STEPS}))] as hi))"""
_BRACKETS = f"""aggregate(array_sort(array_distinct({_NEAR})), slice({_NEAR}, 1, 0), (done, x) ->
    case when size(done) > 0 and element_at(done, -1).hi >= x.lo
    then concat(slice(done, 1, size(done) - 1),
        array(struct(element_at(done, -1).lo as lo, greatest(element_at(done, -1).hi, x.hi) as hi)))
    else concat(done, array(x)) end)"""
_WHOLE = "array(struct(lo, hi))"


def _tally(df: DataFrame, targets: DataFrame, keys: list[str], value: str, brackets: str) -> DataFrame:
    """Second pass: ``cnt`` per key, place and, in odd places (inside a bracket), value."""
    small = F.broadcast(
        targets.withColumn("b", F.expr(brackets)).selectExpr(
            *[f"{k} as span_{k}" for k in keys], "transform(b, x -> x.lo) as los", "transform(b, x -> x.hi) as his"
        )
    )
    place = f"size(filter(los, e -> {value} >= e)) + size(filter(his, e -> {value} > e)) as place"
    placed = df.join(small, F.expr(" and ".join(f"{k} = span_{k}" for k in keys))).selectExpr(*keys, value, place)
    inside = F.expr(f"if(place % 2 = 1, {value}, null) as {value}")
    return materialise(placed.groupBy(*keys, "place", inside).agg(F.expr("count(1) as cnt")), "tally")


def _first_spans(tally: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The brackets with the wanted ranks that they really hold."""
    places = tally.groupBy(*keys, "place").agg(
        F.expr("sum(cnt) as cnt"), F.expr(f"min({value}) as lo"), F.expr(f"max({value}) as hi")
    )
    before = f"""sum(cnt) over (partition by {", ".join(keys)} order by place
        rows between unbounded preceding and 1 preceding)"""
    wanted = F.broadcast(targets.select(*keys, "n", "ranks"))
    return (
        places.withColumn("below", F.expr(f"coalesce({before}, 0)"))
        .where("place % 2 = 1")
        .join(wanted, keys)
        .withColumn("ranks", F.expr("filter(ranks, r -> r >= below and r < below + cnt)"))
        .where("size(ranks) > 0")
        .select(*keys, "lo", "hi", "below", "n", "ranks", "cnt")
    )


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    targets: DataFrame,
    bins: int = BINS,
    few: int = FEW,
) -> DataFrame:
    """Values at the wanted ranks: one row per key and rank.

    ``targets`` comes from ``rank_targets`` over the same rows. ``keys`` must
    come from closed domains (categories, column names), because the spans
    being narrowed are broadcast; more than ``MOST_SPANS`` of them are refused.
    Null and NaN values have no rank. Rows are read once here, whatever the
    number of rounds. Returns the keys, ``n``, ``rank`` and ``value``.
    """
    df = df.select(*keys, value).where(f"{value} is not null and not isnan({value})")
    targets = materialise(targets, "targets")
    valid = "coalesce(sum(size(filter(ranks, r -> r >= 0 and r < n))), 0)"
    size = targets.agg(F.count(F.lit(1)), F.expr(valid)).first()
    if size[0] > MOST_SPANS:
        raise ValueError(f"{size[0]} keys; order statistics need keys of a closed domain")
    for brackets in (_BRACKETS, _WHOLE):
        tally = _tally(df, targets, keys, value, brackets)
        spans = materialise(_first_spans(tally, targets, keys, value), "spans")
        # The sketch rounds whole numbers beyond 2**53, so its brackets are checked.
        if spans.agg(F.expr("coalesce(sum(size(ranks)), 0)")).first()[0] == size[1]:
            break
    inside = tally.where("place % 2 = 1").drop("place")
    for _ in range(8):
        left = spans.agg(F.count(F.lit(1)), F.expr(f"count_if(cnt > {few} and lo < hi)")).first()
        if left[0] > MOST_SPANS:
            raise ValueError(f"{left[0]} spans; order statistics need keys of a closed domain")
        if not left[1]:
            break
        counts = (
            _in_span(inside, spans, keys, value)
            .groupBy(*keys, *_SPAN, F.expr(_bin(value, bins)))
            .agg(
                F.expr("sum(cnt) as cnt"),
                F.expr(f"min({value}) as bin_lo"),
                F.expr(f"max({value}) as bin_hi"),
            )
        )
        spans = materialise(_keep_hit_bins(counts, keys, "bin"), "spans")
    else:
        raise RuntimeError("spans of values could not be narrowed in eight rounds")
    distinct_values = (
        _in_span(inside, spans, keys, value)
        .groupBy(*keys, *_SPAN, F.expr(f"{value} as bin_lo"))
        .agg(F.expr("sum(cnt) as cnt"), F.expr(f"max({value}) as bin_hi"))
    )
    return _keep_hit_bins(distinct_values, keys, "bin_lo").selectExpr(
        *keys, "n", "explode(ranks) as rank", "lo as value"
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Quantiles with linear interpolation, one column per name."""
    lower = {name: f"floor((n - 1) * {float(p)!r}D)" for name, p in probabilities.items()}
    wanted = ", ".join(f"{at}, least({at} + 1, n - 1)" for at in lower.values())
    targets = rank_targets(df, keys, value, f"array_distinct(array({wanted}))")
    by_rank = (
        order_statistics(df, keys, value, targets)
        .groupBy(*keys, "n")
        .agg(F.expr("map_from_entries(collect_list(struct(rank, double(value)))) as at"))
    )

    def quantile(name: str, p: float) -> str:
        at, share = lower[name], f"((n - 1) * {float(p)!r}D - {lower[name]})"
        above = f"at[least({at} + 1, n - 1)]"
        return f"at[{at}] + ({above} - at[{at}]) * {share} as {name}"

    return by_rank.selectExpr(*keys, "n", *[quantile(k, p) for k, p in probabilities.items()])


def long_numeric(df: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """One row per record and numeric column: keys, ``variable``, ``value``."""
    pairs = ", ".join(f"'{c}', double({c})" for c in columns)
    return df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (variable, value)")
