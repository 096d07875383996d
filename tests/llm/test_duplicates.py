"""Similarity joins, repeated spans and near vectors against brute force."""

import math
import random

import numpy as np
import pytest

from dayprint.llm import debruijn_dedup, minhash_join
from dayprint.llm.components import components
from dayprint.llm.minhash_join import bands_for, linked, representatives, similar
from dayprint.llm.multi_index import Grid, depth, link_recall, near_vectors


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    loose = [(draw.randint(200, 300), draw.randint(200, 300)) for _ in range(60)]
    links = chain + star + loose + [(400, 400)]
    draw.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == groups(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def ngrams(text, width=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def copies(spark, prose_of):
    """Copies, near copies on both sides of the threshold, and one large group of near copies."""
    draw, rows = random.Random(7), []
    for k in range(12):
        base = prose_of(k, 120).split()
        for changes in (0, 0, 1, 2, 3, 4, 5, 8):
            words = list(base)
            for _ in range(changes):
                words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
            rows.append(" ".join(words))
    base = prose_of(99, 40).split()
    for i in range(150):
        words = list(base)
        words[i % 40] = f"v{i}"
        rows.append("  ".join(words))
    rows += ["a b c", "a b c", "a b d", None, "", " "]
    draw.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def brute_links(rows, threshold=0.8):
    sets = [(i, ngrams(t)) for i, t in rows]
    return [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and len(s & t) >= threshold * len(s | t)]


@pytest.mark.parametrize("block", [minhash_join.BLOCK, 900])
def test_similar_equals_brute_force(copies, monkeypatch, block):
    monkeypatch.setattr(minhash_join, "BLOCK", block)  # small blocks: every pair of blocks is a piece of work
    rows = [(r["doc_id"], r["text"]) for r in copies.collect()]
    links = brute_links(rows)
    want = groups([i for i, _ in rows], links)
    count = {i: sum(i in x for x in links) for i, _ in rows}
    got = similar(copies).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"]: r["n_links"] for r in got} == count


def test_similar_hard_rows(hard_docs, no_docs):
    got = similar(hard_docs).collect()
    assert len(got) == hard_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert by[0] == [(0, 4)] and by[2] == [(0, 4)] and by[13] == [(0, 4)] * 2
    assert by[6] == [(6, 1)] and by[7] == [(6, 1)] and by[8] == [(8, 1)] and by[9] == [(8, 1)]
    assert by[3] == [(3, 0)] and by[4] == [(4, 0)] and by[5] == [(5, 0)] and by[None] == [(None, 0)] * 2
    assert similar(no_docs).count() == 0


def test_representatives(hard_docs, no_docs):
    kept = representatives(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == [-1, -1, 0, 3, 4, 5, 6, 8, 10, 11, 12]
    assert representatives(hard_docs.where("doc_id = 13")).count() == 1
    assert representatives(no_docs).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99), (0.8, 0.9999), (0.5, 0.9), (1.0, 0.9)):
        bands, rows = bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        bands_for(0.1, 0.999999999, 4)


def test_both_ways_of_counting_agree(monkeypatch):
    draw = np.random.default_rng(0)
    sets = [np.sort(draw.choice(400, draw.integers(60, 80), replace=False)).astype(np.uint64) for _ in range(40)]
    sets += [np.sort(np.append(s[:-1], np.uint64(1000 + i))) for i, s in enumerate(sets[:20])]
    bands, block = np.zeros((60, 1), np.uint64), np.zeros(60, int)
    want = [[i != j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (linked(sets, bands, block, 0.8) == np.array(want)).all()
    few = bands.copy()
    few[:, 0] = np.arange(60) % 20
    assert (linked(sets, few, block, 0.8) == (np.array(want) & (few == few.T))).all()


def brute_spans(rows, width=50):
    """{doc_id: (words, removed, kept)} for distinct doc_ids; null counts as the largest."""
    key = lambda i: math.inf if i is None else i
    first = {}
    words = [(key(i), (t or "").split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - width + 1):
            x = tuple(w[p : p + width])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = {p + k for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < i for k in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def spans_of(df):
    return sorted((math.inf if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in debruijn_dedup.without_repeats(df).collect())


def test_repeated_spans_equal_brute_force(spark, prose_of):
    draw = random.Random(5)
    passages = [prose_of(200 + k, n).split() for k, n in enumerate((49, 50, 51, 60, 75, 120, 300))]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randint(1, 4)):
            words += prose_of(1000 + draw.randrange(10**6), draw.randint(0, 60)).split()
            p = draw.choice(passages)
            a = draw.randrange(0, 5)
            words += p[a : len(p) - draw.randrange(0, 5)]
        rows.append((i, " ".join(words)))
    rows += [(100, "same " * 130), (101, "same " * 90), (102, "a b " * 80), (103, "b a " * 80), (104, rows[3][1]), (105, rows[3][1] + " more")]
    draw.shuffle(rows)
    assert spans_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows)


def test_repeated_spans_hard_rows(hard_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    docs = hard_docs.withColumnRenamed("kept", "n_words").withColumnRenamed("spans", "other")
    assert spans_of(docs) == brute_spans(rows)
    assert debruijn_dedup.without_repeats(no_docs).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((600, 16))
    parts = [x, x[:80] + 0.12 * draw.standard_normal((80, 16)), x[:40], x[5] + 0.05 * draw.standard_normal((150, 16)), 3 * x[40:60]]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(np.concatenate(parts))]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0]]
    return spark.createDataFrame(rows + [(n + i, v) for i, v in enumerate(odd)], "vec_id long, embedding array<float>")


def test_near_vectors(vectors):
    rows = vectors.orderBy("vec_id").collect()
    good = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] and len(r["embedding"]) == 16 and None not in r["embedding"] and 0 < np.linalg.norm(r["embedding"]) < np.inf]
    u = np.array([v for _, v in good])
    u /= np.linalg.norm(u, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    links = [(good[a][0], good[b][0]) for a, b in np.argwhere(np.triu(close))]
    want = groups([r["vec_id"] for r in rows], links)
    got = {r["vec_id"]: r for r in near_vectors(vectors.selectExpr("vec_id", "embedding", "'x' as cell")).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    true = dict(zip([g[0] for g in good], close.sum(1)))
    assert all(r["n_links"] <= true.get(i, 0) for i, r in got.items())
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.98
    assert all(got[r["vec_id"]]["component_id"] == r["vec_id"] and not got[r["vec_id"]]["n_links"] for r in rows[-7:])


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = near_vectors(spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (9, None)], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in one) == [(5, 1, 5), (5, 1, 5), (9, 0, 9)]


def test_visits_are_the_nearest_cells():
    x = np.random.default_rng(1).standard_normal((300, 8))
    grid = Grid(x, 8)
    cells, far = grid.visits(x[:20], 10)
    d1, d2 = grid.distances(x[:20])
    full = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
    assert np.allclose(far, np.sort(full, 1)[:, :10])
    assert np.allclose(np.take_along_axis(full, cells, 1), far)
    assert (grid.rank(x[:20], grid.cell(x[:20])) == 1).all()


def test_two_texts_under_one_id(spark, prose_of):
    """Near copies of both texts find theirs."""
    one, two = prose_of(1, 120), prose_of(2, 120)
    change = lambda t, w: t.replace(t.split()[60], w, 1)
    rows = [(1, one), (1, two), (2, change(one, "other")), (3, change(two, "thing")), (4, prose_of(3, 120))]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


@pytest.mark.parametrize("step, kind", [(1e-4, "float"), (1e-9, "double")])
def test_ties_between_cells(spark, step, kind):
    """Vectors that lie as near to several centroids: every link counts for both sides."""
    rows = [(i, [1.0, 0.1 + step * i]) for i in range(5)]
    got = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    assert [r["n_links"] for r in got] == [4] * 5 and {r["component_id"] for r in got} == {0}


def test_doubles_are_compared_as_doubles(spark):
    """A pair just below the threshold that single precision would lift."""
    angle = math.acos(0.95) + 1e-9
    rows = [(0, [1.0, 0.0]), (1, [math.cos(angle), math.sin(angle)])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r["n_links"] for r in got] == [0, 0]


def test_rare_pairs_are_found(spark):
    """300 pairs just above the threshold among 12,000 vectors without neighbours."""
    draw = np.random.default_rng(9)
    x = draw.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = draw.standard_normal((300, 32))
    away -= (away * x[:300]).sum(1)[:, None] * x[:300]
    cosine = draw.uniform(0.952, 0.99, 300)[:, None]
    near = cosine * x[:300] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(rows).collect()}
    met = [i for i in range(300) if got[12_000 + i]["component_id"] == i]
    assert len(met) >= 299
    assert sum(r["n_links"] for r in got.values()) == 2 * len(met)


def test_link_recall_counts_against_brute_force(spark, vectors):
    rows = vectors.where("vec_id < 870")  # without the odd ones
    found, there = link_recall(rows, near_vectors(rows), every=5)
    u = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    u /= np.linalg.norm(u, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    assert there == close[::5].sum() and 0.99 * there <= found <= there


def test_depth_follows_the_evidence():
    made = np.arange(1, 1001)
    assert depth([], 0, made, 0.999) == 999  # nothing real: partners at the threshold
    assert depth([(1, 199.0), (3000, 1.0)], 200, made, 0.999) == 3000  # a query alone counts as much as any other
    assert depth([(1, 200.0)], 200, made, 0.999) == 900  # enough real ones: partners need 0.9
    assert depth([(1, 20.0)], 20, made, 0.999) == 999
