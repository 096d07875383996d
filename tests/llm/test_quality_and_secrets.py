"""Quality cascade and secret scan against plain Python."""

import base64
import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dayprint.llm import quality_cascade as q
from dayprint.llm import secret_scan as s
from dayprint.llm.columns import prefix_sums


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


@pytest.fixture(scope="module")
def awkward(spark, hard_docs, prose_of):
    more = ["a b c d e a b c d e", "x " * 30, "a b c d e f a b c d e", "A||B *** # <>\n\n\nA||B", "  not a space", prose_of(9, 30) + " " + prose_of(9, 30), "SHOUT " * 5 + prose_of(5, 12)]
    rows = [(100 + i, t) for i, t in enumerate(more)]
    return hard_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))


def test_counts(awkward):
    for r in q.measured(awkward).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(r["text"])


def test_order_never_changes_the_verdict(awkward):
    rules = q.rules()
    verdicts = [{(r["doc_id"], r["text"]): r["v"] is None for r in awkward.withColumn("v", q.rejected_by(c)).collect()} for c in (rules, rules[::-1])]
    alone = {(r["doc_id"], r["text"]): not r["v"] for r in q.measured(awkward).withColumn("v", _any(q.rules(False))).collect()}
    assert verdicts[0] == verdicts[1] == alone


def _any(rules):
    out = F.lit(False)
    for r in rules:
        out = out | r.rejects
    return out


def test_order_by_rejections_per_cost(awkward):
    found = [q.Estimate(q.Rule("a", F.lit(True)), 2.0, 0.5), q.Estimate(q.Rule("b", F.lit(True)), 0.1, 0.2), q.Estimate(q.Rule("c", F.lit(True)), 1.0, 0.0)]
    assert [r.name for r in q.ordered(found)] == ["b", "a", "c"]
    measured = q.estimates(awkward, q.rules(), 1000)
    assert {e.rule.name for e in measured} == {r.name for r in q.rules()} and all(0 <= e.rejected <= 1 for e in measured)


def test_kept_keeps_columns(hard_docs, no_docs):
    kept = q.kept(hard_docs)
    assert kept.columns == hard_docs.columns and {r["slot"] for r in kept.collect()} == {"s"}
    names = [r["doc_id"] for r in kept.collect()]
    assert {0, 1, 2, 12}.issubset(names) and not {3, 4, 5, 8}.intersection(names) and names.count(13) == 2
    assert q.kept(no_docs).count() == 0


def test_prefix_sums(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([5],), ([],)], "v array<int>")
    for r in df.select("v", prefix_sums(F.col("v")).alias("p")).collect():
        assert r["p"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]


BASE = {k: (re.compile(p), g, n) for k, (p, g, n) in s.PATTERNS.items()}


def plain_spans(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@pytest.fixture(scope="module")
def with_secrets(spark, hard_docs, prose_of):
    draw = random.Random(3)
    key = base64.b64encode(draw.randbytes(30)).decode()
    texts = [f"{prose_of(20 + i, 30)} {base64.b64encode(draw.randbytes(24 + i)).decode()} end" for i in range(12)]
    texts += [f"{prose_of(50 + i, 20)} thequickbrownfoxjumpsoverthelazydog-and-more_of-it/en/docs/index end 12345678901234567890123" for i in range(12)]
    texts += ["token: secret : abcdefghijkl", "API_KEY='aaaa.bbbb-cccc=' apikey=12345678901", "Pässword=nothing1234567 é token=abcdefghijkl0", f"secret={key} 0123456789abcdef0 AKIA AKIA1234567890ABCD"]
    rows = [(200 + i, t) for i, t in enumerate(texts)]
    return hard_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))


def test_base_spans(with_secrets):
    for r in s.scanned(with_secrets).select("text", s.listed(F.col("base_spans")).alias("base"), s.listed(F.col("spans")).alias("all")).collect():
        assert r["base"] == plain_spans(r["text"])
        assert set(filter(None, r["base"].split(","))) <= set(r["all"].split(","))


def test_random_strings_are_found_and_words_are_not(with_secrets):
    rows = {r["doc_id"]: (r["text"], r["all"]) for r in s.scanned(with_secrets).select("doc_id", "text", s.listed(F.col("spans")).alias("all")).collect()}
    found = [rows[200 + i][1].count("random:") for i in range(24)]
    assert sum(found[:12]) >= 10 and sum(found[12:]) == 0


WORDS = "internationalization wheretheriverbendsandthehillsrise rechtsschutzversicherungsgesellschaften configurationmanagementservice2024 ELECTROENCEPHALOGRAPHICALLY".split()
ALPHABETS = {
    "base 36": "abcdefghijklmnopqrstuvwxyz0123456789", "upper base 36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "lower base 32": "abcdefghijklmnopqrstuvwxyz234567",
    "base 26": "abcdefghijklmnopqrstuvwxyz", "upper base 26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base 32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
}


def test_tokens_of_one_letter_case_are_found(spark, prose_of):
    draw = random.Random(8)
    tokens = ["".join(draw.choice(x) for _ in range(draw.choice((24, 32, 40)))) for x in ALPHABETS.values() for _ in range(40)]
    rows = [(i, f"{prose_of(i, 12)} {t} end") for i, t in enumerate(tokens)] + [(1000 + i, f"see {w} here") for i, w in enumerate(WORDS * 48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["all"] for r in s.scanned(docs).select("doc_id", s.listed(F.col("spans")).alias("all")).collect()}
    for k, name in enumerate(ALPHABETS):
        assert sum("random:" in found[40 * k + i] for i in range(40)) >= 37, name
    assert not any("random:" in x for i, x in found.items() if i >= 1000)


def test_rejection_bins():
    # ten strings: nine with p = 0.5, one with p = 1e-6; 1e-6 <= 0.01 / 10 is rejected alone
    low, high = int(6 * s.BINS), int(0.301 * s.BINS)
    assert s.rejection_bins({(0, low): 1, (0, high): 9}) == {0: low}
    assert s.rejection_bins({(0, high): 9})[0] > 10**6


def test_masked(hard_docs, no_docs):
    out = s.masked(hard_docs)
    assert out.columns == hard_docs.columns and out.count() == hard_docs.count()
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert rows[11]["text"] == 'x [secret]" y [secret] token=short [secret]' and rows[11]["n_chars"] == len(rows[11]["text"])
    assert rows[3]["text"] is None and rows[6]["text"] == {r["doc_id"]: r["text"] for r in hard_docs.collect()}[6] and rows[6]["spans"] is None
    assert s.masked(no_docs).count() == 0


def test_empty_hash(hard_docs):
    r = s.scanned(hard_docs.where("doc_id = 4")).select(F.sha2(s.listed(F.col("base_spans")), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(b"").hexdigest()
