"""Hard negatives and ranked search against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from dayprint.llm import block_max, hyperplane_tree
from dayprint.llm.block_max import Best, Shard, index_terms, packed, pieces, ranked, searched, term_hashes, unpacked
from dayprint.llm.hyperplane_tree import Tree, hard_negatives

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x string, leaf string, k string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_ranked_search"])
def test_queries_match_sql(spark, name):
    line = compare(spark, duck(SMALL), SMALL, name)
    assert line.startswith("ok"), line


def mined(rows, anchors, n_pos=5, n_neg=5):
    sound = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [math.floor(256 * x) for x in v])
        sound[i] = min(sound.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(sound[a][1], sound[b][1]))
    out = []
    for a in sorted(i for i in sound if anchors(i)):
        best = sorted((-dot(a, b), b) for b in sound if b != a)
        for s, p in [x for x in best if sound[x[1]][0] == sound[a][0]][:n_pos]:
            fit = [(t, b) for t, b in best if sound[b][0] != sound[a][0] and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(fit[:n_neg])]
    return sorted(out)


def test_many_leaves(spark, monkeypatch):
    """A deep tree over clustered vectors with a third of equal ones, blocks of anchors, ties."""
    monkeypatch.setattr(hyperplane_tree, "LEAF_ROWS", 20)
    monkeypatch.setattr(hyperplane_tree, "FAN", 5)
    monkeypatch.setattr(hyperplane_tree, "ANCHORS", 40)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 6))
    rows = []
    for i in range(900):
        v = [1.0, 0.5, 0, 0, 0.25, 0] if i % 3 == 0 else list(centres[i % 12] + 0.2 * draw.normal(size=6))
        rows.append((i, [float(x) for x in v], int(draw.integers(0, 4)), None, None, None))
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    want = mined([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert want and sorted(map(tuple, got.collect())) == want


def test_tree_leaves_out_leaves_and_loses_none():
    draw = np.random.default_rng(1)
    x = (draw.normal(size=(8, 5))[draw.integers(0, 8, 20_000)] * 200 + draw.normal(size=(20_000, 5)) * 10).astype(np.int64)
    norm2 = int((x * x).sum(1).max())
    tree = Tree(x[:4000], norm2, len(x))
    seen = {}
    leaf = tree.placed(x.astype(float), seen)
    for (n, i, j), (a, b) in seen.items():
        tree.low[n][i, j], tree.high[n][i, j] = a, b
    q = x[:50].astype(float)
    scores = q @ x.T
    least = np.sort(scores, 1)[:, -20]
    outer = np.sqrt(np.maximum((q * q).sum(1) + norm2 - 2 * least, 0)) + 1e-6 * (1 + math.sqrt(norm2))
    dist, visited = tree.asked(q), 0
    for one in range(len(tree.paths)):
        ok = tree.meets(one, dist, np.zeros(50), outer)
        here = leaf == one
        assert not ((scores[:, here] >= least[:, None]).any(1) & ~ok).any()
        visited += int(ok.sum()) * int(here.sum())
    assert visited < 0.5 * scores.size


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, nan], 2), (7, [inf, 1.0], 1),
        (8, [1.0, 0.4], None), (None, [1.0, 0.5], 2), (9, [1.0, 0.5, 0.5], 1), (10, [], 1), (11, [-1.0, -0.5], 1), (12, [0.0, 0.0], 1), (13, [0.95, 0.5], 2), (13, [0.9, 0.5], 1), (20, [-1.0, 0.1], 3), (30, [-1.0, 0.1], 3),
    ]
    docs = spark.createDataFrame([(*r, None, None, "k") for r in rows], VECTORS)
    want = mined([r for r in rows if r[1] is None or len(r[1]) == 2], lambda i: i % 10 == 0)
    assert sorted(map(tuple, hard_negatives(docs, F.col("vec_id") % 10 == 0).collect())) == want
    assert hard_negatives(docs.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(docs.where("embedding is null"), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives(spark.createDataFrame([(0, [1e12], 1, None, None, None)], VECTORS), F.col("vec_id") == 0)


def brute(docs, items, k=50):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, cut(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + (50 * len(b) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in terms if t in df and t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(prose_of):
    draw = random.Random(3)
    words = prose_of(8, 300).split()
    weight = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weight, k=draw.choice([3, 40, 400])))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(200)]
    items = [(i, " ".join(draw.sample(words, 12))) for i in range(15)]
    return docs, items


def test_small_shards_and_windows(spark, corpus, monkeypatch):
    """Shards of 64 documents, blocks of 4 postings, windows of 16: thresholds rise and lists become non-essential."""
    monkeypatch.setattr(block_max, "SHARD_DOCS", 64)
    monkeypatch.setattr(block_max, "BLOCK", 4)
    monkeypatch.setattr(block_max, "WINDOW", 16)
    docs, items = corpus
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ranked(d, i, k=10).collect()), key=str)
    assert got == brute(docs, items, 10)


def test_blocks_of_items(spark, corpus, monkeypatch):
    monkeypatch.setattr(block_max, "BROADCAST_BYTES", 4000)
    docs, items = corpus
    got = ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_block_maxima_spare_decoding(corpus, monkeypatch):
    """The best of one shard come out the same as by full scores, with fewer postings decoded."""
    monkeypatch.setattr(block_max, "BLOCK", 4)
    monkeypatch.setattr(block_max, "WINDOW", 32)
    docs, _ = corpus
    terms = sorted({w for _, t in docs for w in t.split()})
    number = {t: i for i, t in enumerate(terms)}
    rows = [(d, number[w], t.split().count(w)) for d, (_, t) in enumerate(docs) for w in sorted(set(t.split()))]
    doc, term, tf = (np.array(x) for x in zip(*rows))
    df = np.bincount(term, minlength=len(terms))
    weights = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * df + 1))).astype(np.int64)
    lengths = np.array([len(t.split()) for _, t in docs])
    m = 50 + (50 * lengths * len(docs)) // lengths.sum()
    ids = np.array([i for i, _ in docs])
    shard = Shard.built(ids, np.zeros(len(ids), bool), m, doc, term, tf, weights)
    again = Shard({f: np.frombuffer(b, k) for (f, k), b in zip(block_max.FIELDS.items(), shard.row())})
    asked = np.argsort(-df)[[0, 1, 2, 20, 60, 100, 150]]
    full = np.zeros(len(ids), np.int64)
    for d, t, n in rows:
        if t in asked:
            full[d] += weights[t] * ((10**9 * n) // (1000 * n + 20 * m[d]))
    best = Best(10)
    work = searched(again, asked, weights, best)
    order = np.lexsort((ids, -full))[:10]
    assert best.ids.tolist() == ids[order].tolist() and best.scores.tolist() == full[order].tolist()
    assert work < 0.9 * np.isin(term, asked).sum()


def test_packed_values():
    x = np.array([0, 254, 255, 256, 70_000, 3])
    low, places, large = packed(x)
    assert unpacked(low, places, large, np.array([5, 4, 3, 2, 1, 0])).tolist() == x[::-1].tolist()


def test_long_texts_are_cut_between_terms():
    text = "Ab,cé " * 500 + "x" * 4000 + " end"
    whole, n = term_hashes(pa.array([text]))
    parts = [term_hashes(t)[0] for _, t in pieces(pa.array(["a", None, text, "b"]), most=100)]
    assert np.concatenate(parts).tolist() == [*term_hashes(pa.array(["a"]))[0], *whole, *term_hashes(pa.array(["b"]))[0]] and n[0] == len(whole)


def test_hard_docs(spark, hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    items = [(1, "One word1x1 word2x2 secret, PASSWORD same"), (1, "line"), (2, None), (3, ""), (None, "one"), (4, "à plage ÉTE"), (5, rows[0][1])]
    asked = spark.createDataFrame([(i, t, "d", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    assert sorted(map(tuple, ranked(hard_docs, asked).collect()), key=str) == brute(rows, items)
    assert ranked(no_docs, asked).count() == 0
    assert ranked(hard_docs, asked.limit(0)).count() == 0
    assert index_terms(no_docs, [])[0].count() == 0
