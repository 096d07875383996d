"""Quality rules as a short-circuit cascade.

Each rule is a Boolean expression over a document that is true where the rule rejects it. The cost and the rejection
rate of every rule are measured on a sample; rules then run in falling order of rejections per cost, each only on what
the ones before have left. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayprint.llm.columns import SPACES, let, words
from dayprint.llm.store import dropped, stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(ws: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def marked(s: Column) -> Column:
            n = F.size(s)
            same = F.zip_with(s, F.slice(s, F.lit(2), n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            twice = let(same, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, F.lit(1), n - 1)), lambda a, b: a | b))
            return F.filter(F.zip_with(s, twice, lambda a, d: F.when(d, a["at"])), lambda p: p.isNotNull())

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.sort_array(let(order, marked)),
            start,
            lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")),
        )["total"].cast("long")

    def counted(w: Column) -> Column:
        last = F.size(w) - (WINDOW - 1)
        windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(last < 2, F.lit(0).cast("long")).otherwise(repeats)

    return let(ws, counted)


def measured(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "n_words": F.size(words(text)).cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(words(text)),
        }
    )


def rules(from_text: bool = True) -> list[Rule]:
    """The rules, over `text` alone or over the columns of `measured` besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if from_text:
        n, chars, symbols, lines = F.size(words(text)), word_chars(text), n_symbols(text), n_dup_lines(text)
        repeated = let(words(text), lambda w: 100 * n_repeat_words(w) > 20 * F.size(w))
    else:
        n, chars, symbols, lines = (F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))
        repeated = 100 * F.col("n_repeat_words") > 20 * n
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return [
        Rule("few words", n < 10),
        Rule("repeated windows", repeated),
        # one symbol per ten words
        Rule("symbols", let(n, lambda x: 10 * symbols > x)),
        Rule("word length", let(n, lambda x: (chars < 2 * x) | (chars > 20 * x))),
        Rule("capitals", 2 * capitals > chars),
        Rule("repeated lines", 2 * lines > F.size(F.split(text, "\n", -1))),
    ]


def estimates(docs: DataFrame, cascade: Sequence[Rule], sample_rows: int, seed: int = 7) -> list[Estimate]:
    """Cost and rejection rate of each rule over a random sample of about sample_rows documents."""
    total = docs.count()
    sample = stored(docs.sample(min(1.0, sample_rows / max(total, 1)), seed), "sample", "lz4")
    spent = lambda began: time.perf_counter() - began
    began = time.perf_counter()
    size = sample.select(F.count(F.col("text")).alias("n")).first()["n"]
    scan = spent(began)
    out = []
    for rule in cascade:
        began = time.perf_counter()
        hit = sample.select(F.count_if(rule.rejects).alias("n")).first()["n"]
        out.append(Estimate(rule, max(spent(began) - scan, 0.0), hit / max(size, 1)))
    dropped(docs.sparkSession, sample)
    return out


def ordered(found: Sequence[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(found, key=lambda e: -e.worth)]


def rejected_by(cascade: Sequence[Rule]) -> Column:
    """The first rule of the cascade that rejects the document, or null; later rules do not run for it."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(cascade):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(True)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, cascade: Sequence[Rule], sample_rows: int = 2000) -> DataFrame:
    """The documents with `rejected_by`. Null and empty texts have no words and are rejected; repeated rows are judged alike."""
    return docs.withColumn("rejected_by", rejected_by(ordered(estimates(docs, cascade, sample_rows))))


def kept(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The documents that no rule rejects, with their own columns whatever their names; null and empty texts are rejected."""
    return docs.where(rejected_by(ordered(estimates(docs, rules(), sample_rows))).isNull())


#: The same verdicts in DuckDB.
VERDICTS_SQL = r"""
  with d as (select doc_id, coalesce(text, '') as t from documents),
  w as (select doc_id, t, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] as ws from d),
  win as (select doc_id, i, list_slice(ws, i, i + 4) as v from w, unnest(range(1, len(ws) - 3)) as r(i)),
  twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, v) as c from win) where c > 1),
  cover as (select doc_id, count(distinct i + k) as n from twice, range(0, 5) as r(k) group by doc_id),
  lines as (select doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls, len(string_split(t, chr(10))) as n_lines from d),
  m as (select doc_id, t, cast(len(ws) as bigint) as n_words,
      cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
      cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
      cast(coalesce(n, 0) as bigint) as n_repeat_words,
      length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) as capitals, n_lines
    from w join lines using (doc_id) left join cover using (doc_id)),
  v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
      10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
        or 2 * capitals > word_chars or 2 * n_dup_lines > n_lines as method_failed from m)
"""
