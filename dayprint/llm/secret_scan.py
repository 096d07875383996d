"""Secrets in texts: fixed patterns, and random-looking strings found by a battery of randomness tests.

Only DataFrame functions. Strings of 20 or more letters, digits and + / _ = - get the smallest encoding that can hold
them: base 26, hex, base 32 or base 36 of one letter case, or base 64. Four tests of "every symbol is equally likely,
each on its own" are made: chi-squared over the alphabet, chi-squared over its classes (digits, capitals, small letters,
signs; within one letter case the letters that are frequent in words and the others), runs above and below the middle,
and serial correlation. Their p values are combined by Cauchy's rule, which allows dependent tests.
A rejection says "this string has structure". Within each range of lengths (short strings have little power, long ones
much) Benjamini and Hochberg's step-up keeps the false share of rejections at Q; what is not rejected is a secret.
Strings of digits alone and capitalised words are no secrets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayprint.llm.columns import let, prefix_sums
from dayprint.llm.store import stored

# The base patterns, the least length of what counts, and the group that is measured.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
KINDS = [*PATTERNS, "random"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Half of the letters: those that make up about 85 % of words in English, German, French and Spanish. The other half.
FREQUENT, RARE = "etaoinsrhldcu", "bfgjkmpqvwxyz"
#: Letters by that order, so that halves of the alphabet are halves by frequency.
BASE26 = FREQUENT + RARE
BASE32 = LETTERS + "234567"
BASE36 = "0123456789" + LETTERS
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The share of wrongly rejected strings among the rejected ones.
Q = 0.01
#: Ends of the ranges of lengths that are controlled on their own.
LENGTHS = (32, 64, 256)
#: p values are counted in steps of this many to a power of ten.
BINS = 64
SPAN = "struct<start:int,kind:int,end:int>"


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """(start, kind, end) of leftmost non-overlapping matches whose group has `least` characters, in code points."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def spans(ms: Column) -> Column:
        lengths = F.transform(ms, F.length)
        between = F.transform(F.split(text, pattern, -1), F.length)
        gone = let(lengths, lambda n: F.zip_with(prefix_sums(F.slice(between, F.lit(1), F.size(ms))), prefix_sums(n), lambda a, b: a + b))
        starts = F.zip_with(gone, F.slice(between, F.lit(1), F.size(ms)), lambda a, b: (a + b).cast("int"))
        out = F.zip_with(starts, lengths, lambda s, n: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + n).cast("int").alias("end")))
        measured = F.transform(ms if group == 0 else found(group), F.length)
        return F.filter(F.zip_with(out, measured, lambda s, n: F.when(n >= least, s)), lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), let(found(0), spans)).otherwise(F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    found = [matches(text, *rule, kind) for kind, rule in enumerate(PATTERNS.values())]
    return F.sort_array(F.concat(*found))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by Zelen and Severo's polynomial."""

    def tail(a: Column) -> Column:
        t = 1 / (1 + 0.2316419 * a)
        # The polynomial's coefficients.
        c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
        poly = reduce(lambda acc, k: (acc + F.lit(k)) * t, reversed(c), F.lit(0.0))
        return F.exp(-a * a / 2) / 2.5066282746310002 * poly

    return let(F.abs(z), lambda a: F.when(z >= 0, tail(a)).otherwise(1 - tail(a)))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x) by Wilson and Hilferty's cube root."""
    c = 2 / (9 * df)
    return _upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - c)) / F.sqrt(c))


def p_random(string: Column) -> Column:
    """The combined p value of "random in its encoding"; null where the string is a number or a capitalised word."""

    def battery(s: Column, alphabet: str, shares: dict[str, float]) -> Column:
        size = float(len(alphabet))
        chars = F.filter(F.split(s, ""), lambda c: c != "")

        def tests(v: Column) -> Column:
            n = F.size(v).cast("double")
            zero = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("double").alias("run"), F.lit(0).cast("double").alias("total"))
            squares = F.aggregate(
                F.sort_array(v),
                zero,
                lambda a, x: let(
                    F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0)),
                    lambda r: F.struct(x.alias("last"), r.alias("run"), (a["total"] + 2 * r - 1).alias("total")),
                ),
            )["total"]
            chi = (size / n) * squares - n
            p1 = _upper_tail((chi - (size - 1)) / F.sqrt(2 * (size - 1) * (1 - 1 / n)))
            counts = [F.length(F.regexp_replace(s, f"[^{cls}]", "")) for cls in shares]
            coarse = reduce(lambda a, b: a + b, [F.pow(c - n * e, F.lit(2)) / (n * e) for c, e in zip(counts, shares.values())])
            p2 = _chi_tail(coarse, F.lit(float(len(shares) - 1)))
            high = F.size(F.filter(v, lambda x: x >= size / 2)).cast("double")
            turns = F.aggregate(
                v,
                F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
                lambda a, x: let(
                    F.when(x >= size / 2, 1).otherwise(0),
                    lambda b: F.struct(b.alias("last"), (a["n"] + F.when(a["last"] == b, 0).otherwise(1)).alias("n")),
                ),
            )["n"]
            mean = 2 * high * (n - high) / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            p3 = F.when(var > 0, 2 * _upper_tail(F.abs(turns - mean) / F.sqrt(var))).otherwise(F.lit(1e-9))
            middle = (size - 1) / 2
            series = F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: (a - middle) * F.coalesce(b - middle, F.lit(0.0)))
            add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
            r = add(series) / add(F.transform(v, lambda x: (x - middle) * (x - middle)))
            p4 = 2 * _upper_tail(F.abs(r * F.sqrt(n)))
            clipped = [F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-9)) for p in (p1, p2, p3, p4)]
            cauchy = reduce(lambda a, b: a + b, [F.tan((0.5 - p) * F.pi()) for p in clipped]) / 4
            return F.greatest(0.5 - F.atan(cauchy) / F.pi(), F.lit(1e-15))

        return let(F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1), tests)

    def inferred(s: Column) -> Column:
        return (
            F.when(s.rlike("^([0-9]+|[A-Z][a-z]+)$"), F.lit(None).cast("double"))
            .when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), battery(F.lower(s), HEX, {"0-9": 10 / 16, "a-f": 6 / 16}))
            .when(s.rlike("^([a-z]+|[A-Z]+)$"), battery(F.lower(s), BASE26, {FREQUENT: 13 / 26, RARE: 13 / 26}))
            .when(s.rlike("^([a-z2-7]+|[A-Z2-7]+)$"), battery(F.lower(s), BASE32, {FREQUENT: 13 / 32, RARE: 13 / 32, "2-7": 6 / 32}))
            .when(s.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), battery(F.lower(s), BASE36, {FREQUENT: 13 / 36, RARE: 13 / 36, "0-9": 10 / 36}))
            .when(s == "", F.lit(None).cast("double"))
            .otherwise(battery(s, BASE64, {"A-Z": 26 / 64, "a-z": 26 / 64, "0-9": 10 / 64, "+/": 2 / 64}))
        )

    # padding is no part of the code; the web alphabet's signs take the place of the usual ones
    return let(F.translate(F.regexp_replace(string, "=+$", ""), "-_=", "+/"), inferred)


def _candidates(text: Column) -> Column:
    """(start, end, range of lengths, bin of -log10 p) of strings that may be secrets."""
    ms = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def described(spans: Column) -> Column:
        def one(span: Column, s: Column) -> Column:
            stratum = reduce(lambda a, b: a + b, [F.when(F.length(s) >= n, 1).otherwise(0) for n in LENGTHS])
            step = F.floor(-F.log10(p_random(s)) * BINS).cast("int")
            return F.struct(span["start"].alias("start"), span["end"].alias("end"), stratum.cast("int").alias("stratum"), step.alias("bin"))

        return F.filter(F.zip_with(spans, ms, one), lambda c: c["bin"].isNotNull())

    kind = "array<struct<start:int,end:int,stratum:int,bin:int>>"
    found = let(matches(text, CANDIDATE, 0, 0, 3), described)
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(kind)).cast(kind)


def rejection_bins(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """For each range of lengths the least bin that is rejected (Benjamini and Hochberg); p values round up to their bin's end."""
    out = {}
    for stratum in {s for s, _ in counts}:
        mine = sorted(((b, n) for (s, b), n in counts.items() if s == stratum), reverse=True)
        total, k, least = sum(n for _, n in mine), 0, 1 << 30
        for b, n in mine:
            k += n
            if 10 ** (-b / BINS) <= k * Q / total:
                least = b
        out[stratum] = least
    return out


def scanned(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The documents with `base_spans` and `spans`: sorted arrays of (start, kind, end), kind an index of KINDS.

    `keep` names the columns wanted besides (all by default; columns of the two new names are replaced). Null and empty
    texts have no spans; repeated rows are scanned alike, each counting as a string of its own in the error control.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "spans", "candidates")]
    found = stored(docs.select(*keep, base_spans(text).alias("base_spans"), _candidates(text).alias("candidates")), "secrets")
    # As many rows as there are bins of p values (four ranges, about 1,000 bins each) at most.
    bins = found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    rejected = rejection_bins({(r["stratum"], r["bin"]): r["n"] for r in bins})
    limit = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in (rejected or {0: 0}).items() for x in kv)), c["stratum"])

    def apart(c: Column) -> Column:
        return ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    secrets = F.filter("candidates", lambda c: (c["bin"] < limit(c)) & apart(c))
    added = F.transform(secrets, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    return found.withColumn("spans", F.sort_array(F.concat("base_spans", added))).drop("candidates")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step)
    rest = let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def masked(docs: DataFrame) -> DataFrame:
    """The documents with their own columns whatever their names, secrets in `text` replaced and n_chars, if there, made to follow."""
    found = scanned(docs.select("text", F.struct(*docs.columns).alias("row")), keep=["row"])
    text = redacted(F.col("row.text"), F.col("spans"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length(text).cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
