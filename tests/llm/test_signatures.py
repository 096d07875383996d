"""Order MinHash against a plain version."""

import hashlib
import re

import pytest
import xxhash

from dayprint.llm.catalogue import op12_order_minhash
from dayprint.llm.order_minhash import DIGITS, PLACE_BITS, SLOTS, TAKEN, edits

SMALL = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, seed=h)
    return signed(h)


def number(x):
    return x.to_bytes(8, "little", signed=True)


def fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,12}", text or "")
    if not tokens:
        return "0" * (SLOTS * DIGITS)
    pairs = [(tokens[i], tokens[i + 1]) for i in range(len(tokens) - 1)] or [(tokens[0], None)]
    seen, kmers = {}, []
    for place, pair in enumerate(pairs):
        top = hashed(*pair) >> PLACE_BITS
        j = seen[top] = seen.get(top, -1) + 1
        kmers.append((hashed(number(top), j.to_bytes(4, "little")) >> PLACE_BITS, place))
    kmers.sort()
    out = []
    for s in range(SLOTS):
        begin = -(1 << 63) + s * ((1 << 64) // SLOTS)
        chosen = sorted(range(len(kmers)), key=lambda i: (((kmers[i][0] << PLACE_BITS) + 2 * kmers[i][1] + 1 - begin) % (1 << 64)))[:TAKEN]
        picks = [kmers[chosen[k % len(chosen)]] for k in range(TAKEN)]
        picks.sort(key=lambda p: (p[1], p[0]))
        out.append(f"{hashed(*(number(p[0]) for p in picks)) & ((1 << 4 * DIGITS) - 1):08x}")
    return "".join(out)


def near(a, b):
    cut = lambda x: [x[i : i + DIGITS] for i in range(0, len(x), DIGITS)]
    return sum(x == y for x, y in zip(cut(a), cut(b))) / SLOTS


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], hashed(r[1]), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b = fingerprint(text), fingerprint(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, fingerprint(following))))
    return out


def test_query_equals_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op12_order_minhash(spark, SMALL).collect())
    assert got == sorted(expected(docs))


def test_ranges_meet(spark):
    """Gaps between ids, negative ids and many ranges: every row finds the next one."""
    ids = [(i * i * i) % 100_003 - 50_000 for i in range(1500)]
    rows = [(i, f"text number {i} of many " * 2) for i in sorted(set(ids))]
    got = {r["doc_id"]: r["edited"] for r in edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    rows.sort(reverse=True)
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]]):
        half = len(text) // 2
        assert got[i] == text[: len(text) - half] + following[:half]


def test_hard_rows(spark, hard_docs, no_docs):
    got = edits(hard_docs).collect()
    assert len(got) == hard_docs.count()
    whole = [(r["doc_id"], r["text"]) for r in hard_docs.collect() if r["doc_id"] is not None]
    want = sorted((i, n, a, b) for i, n, _, a, b, _, _ in expected(whole))
    assert sorted((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) for r in got if r["doc_id"] is not None) == want
    for r in got:
        if r["doc_id"] is None:
            assert r["near_next"] is None and len(r["edited"]) == r["n_chars"] - r["n_chars"] // 2
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], r)
    assert by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == by_id[5]["fingerprint"]
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] != by_id[2]["fingerprint"]
    assert edits(no_docs).count() == 0


def test_one_document(spark):
    row = edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()[0]
    assert row["edited"] == "abab" and row["near_next"] == 1.0


def test_order_counts(spark, prose_of):
    """Swapped halves hold the same pairs of words but one, and yet are less alike than a text with a few words changed."""
    words = prose_of(5, 400).split()
    swapped = words[200:] + words[:200]
    few = list(words)
    few[50] = few[250] = "other"
    a, b, c = (fingerprint(" ".join(w)) for w in (words, swapped, few))
    assert near(a, c) > 0.9 > 0.7 > near(a, b)
    repeats = "again and " * 50
    assert near(fingerprint(repeats), fingerprint(repeats * 4)) < 0.9


@pytest.mark.parametrize("text", ["", "one", "one two", "x" * 100])
def test_short_texts(spark, text):
    row = edits(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()[0]
    assert row["fingerprint"] == fingerprint(text) and row["near_next"] == 1.0
