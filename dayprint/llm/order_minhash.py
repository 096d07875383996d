"""Order MinHash: signatures whose likeness falls with the edit distance of two texts.

DataFrame functions only. A text is a row of tokens (words; those longer than 12 characters in parts), its k-mers are pairs of
neighbouring tokens. Equal k-mers are told apart by their occurrence number, so repeats count. Each of SLOTS orders of the
numbered k-mers selects its first two, keeps them in the order in which they stand in the text, and hashes the pair. The
orders are rotations of one random order: order s begins at the s-th of SLOTS equally spaced places of the circle of hashes,
so one sort serves all. The likeness of two fingerprints is their share of equal slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayprint.llm.columns import SPACE

SLOTS, TAKEN = 64, 2
TOKEN = rf"[^{SPACE[1:-1]}]{{1,12}}"
#: A numbered k-mer is one long: its hash above, twice its place plus one below (texts of up to 67 million tokens).
PLACE_BITS = 27
#: Hexadecimal digits of a slot.
DIGITS = 8
#: Documents of a range of ids, ranges at most; ranges hold what one window passes through.
RANGE_DOCS, MOST_RANGES = 128, 65_536


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """The frame with `name`: SLOTS * DIGITS hexadecimal digits. Texts without tokens (also null) share one of their own.

    The steps are columns of their own, so that each is evaluated once and sorts run over unboxed numbers.
    """
    top = lambda x: f"shiftright({x}, {PLACE_BITS})"
    place = lambda x: f"shiftright({x} & {(1 << PLACE_BITS) - 1}L, 1)"
    placed = lambda h, at: f"(shiftleft({top(h)}, {PLACE_BITS}) | (2L * {at} + 1L))"
    numbered = lambda x, j: placed(f"xxhash64({top(x)}, {j})", place(x))
    # marks are even and numbers odd, so they never meet
    marks = ", ".join(f"cast({-(1 << 63) + s * ((1 << 64) // SLOTS)} as bigint)" for s in range(SLOTS))
    pick = lambda k: f"get(_n, pmod(p - s + {k}, size(_n)))"
    hashed = f"if({place('x[0]')} > {place('x[1]')}, xxhash64({top('x[1]')}, {top('x[0]')}), xxhash64({top('x[0]')}, {top('x[1]')}))"
    steps = {
        "_t": f"regexp_extract_all(coalesce(`{text}`, ''), r'{TOKEN}', 0)",
        "_s": f"sort_array(if(size(_t) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size(_t) - 2, 0)), i -> {placed('xxhash64(get(_t, i), get(_t, i + 1))', 'i')})))",
        # where runs of equal k-mers begin, and how long they are
        "_b": f"if(size(_t) = 0, cast(array() as array<int>), filter(sequence(0, greatest(size(_s) - 1, 0)), i -> i = 0 or {top('get(_s, i)')} <> {top('get(_s, greatest(i - 1, 0))')}))",
        "_l": "zip_with(_b, concat(slice(_b, 2, greatest(size(_b) - 1, 0)), array(size(_s))), (a, b) -> b - a)",
        "_n": f"sort_array(flatten(zip_with(_b, _l, (b, n) -> if(n = 1, array({numbered('get(_s, b)', '0')}), transform(slice(_s, b + 1, n), (x, j) -> {numbered('x', 'j')})))))",
        "_m": f"sort_array(concat(_n, array({marks})))",
        "_p": "filter(sequence(0, size(_m) - 1), i -> (get(_m, i) & 1L) = 0L)",
        "_f": f"transform(transform(_p, (p, s) -> array({pick(0)}, {pick(1)})), x -> {hashed} & {(1 << 4 * DIGITS) - 1}L)",
        name: f"if(size(_t) = 0, '{'0' * (SLOTS * DIGITS)}', array_join(transform(_f, h -> lpad(lower(hex(h)), {DIGITS}, '0')), ''))",
    }
    keep = df.columns
    for column, sql in steps.items():
        df = df.withColumn(column, F.expr(sql))
    return df.select(*keep, name)


def likeness(one: str, two: str) -> Column:
    """The share of equal slots."""
    part = lambda x: f"substring({x}, s * {DIGITS} + 1, {DIGITS})"
    return F.expr(f"size(filter(sequence(0, {SLOTS - 1}), s -> {part(one)} = {part(two)})) / {SLOTS}.0D")


def _range_of(value: Column, limits: list[int]) -> Column:
    """How many of the falling limits are at least the value, less one; by two levels of comparisons."""
    wide = max(1, round(len(limits) ** 0.5))
    rows = [limits[i : i + wide] for i in range(0, len(limits), wide)]
    heads = F.array(*(F.lit(r[0]).cast("long") for r in rows))
    table = F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" if x != -(1 << 63) else "cast(-9223372036854775808 as bigint)" for x in r) + ")" for r in rows) + ")")
    row = F.size(F.filter(heads, lambda h: h >= value)) - 1
    return row * wide + F.size(F.filter(F.get(table, row), lambda x: x >= value)) - 1


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every row of (doc_id, text).

    `edited` is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by falling doc_id, after the last by the first. Null and empty texts are empty. Rows with one doc_id follow each
    other by their text's hash. A row with a null doc_id has no place in the order: nothing replaces its half, and near_next
    is null. Further columns are ignored; an empty table gives an empty result.

    Texts are shuffled once, by ranges of doc_ids whose limits are themselves doc_ids: the first rows of each range go also to the
    range before, where they follow the last row. Rows of one doc_id share a range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").where("doc_id is not null").count()
    ranges = min(MOST_RANGES, max(1, n // RANGE_DOCS))
    shares = [i / ranges for i in range(ranges, 0, -1)]
    limits = docs.select(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("x")).first()["x"] or []
    limits = sorted(set(limits), reverse=True)
    rows = with_fingerprint(rows, "text", "fingerprint")
    last = len(limits) - 1
    # the first row of the table follows the last one, the first rows of a range follow those of the range before
    places = F.when(F.col("doc_id").isNull(), F.array(F.struct(F.lit(-1).alias("range"), F.lit(False).alias("extra"))))
    if limits:
        own = F.struct(F.col("home").alias("range"), F.lit(False).alias("extra"))
        other = F.struct(F.when(F.col("home") == 0, F.lit(last)).otherwise(F.col("home") - 1).alias("range"), F.lit(True).alias("extra"))
        first = F.array_contains(F.array(*(F.lit(x).cast("long") for x in limits)), F.col("doc_id")) if last < 64 else F.col("doc_id") == F.get(F.expr("array(" + ",".join(f"{x}L" for x in limits) + ")"), F.col("home"))
        rows = rows.withColumn("home", _range_of(F.col("doc_id").cast("long"), limits))
        places = places.otherwise(F.when(first, F.array(own, other)).otherwise(F.array(own)))
    rows = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "fingerprint", "place.range", "place.extra")
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    order = Window.partitionBy("range", "deal").orderBy("extra", F.desc("doc_id"), F.xxhash64("text"), "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where(~F.col("extra"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    following = F.when(F.col("doc_id").isNotNull(), F.col("next.text"))
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.coalesce(F.substring(following, F.lit(1), half), F.lit("")))
    rows = rows.withColumn("edited", edited)
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    near_next = F.when(F.col("doc_id").isNotNull(), likeness("fingerprint", "next.fingerprint"))
    return rows.select(
        "doc_id", size.cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), near_next.alias("near_next"),
    )
