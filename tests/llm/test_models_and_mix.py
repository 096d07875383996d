"""Class model, latent votes and fair mixing."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from dayprint.llm import class_ngrams, fair_mix, latent_votes


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in (text or ""))


def test_base_columns(hard_docs, no_docs):
    rows = [(r["doc_id"], [w for w in lowered(r["text"]).split()] + [None]) for r in hard_docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 3)) for i, ws in rows)
    got = class_ngrams.scored(hard_docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert class_ngrams.scored(no_docs).count() == 0


def test_words_of_a_slice():
    import pyarrow as pa

    from dayprint.llm.hashing import Words

    texts = pa.array(["An ÉT x", None, "THE  End\n", "", "the end", "b"])
    for lower in (False, True):
        full, part = Words(texts, lower), Words(texts.slice(2, 3), lower)
        assert part.n.tolist() == [2, 0, 2] and full.n.tolist() == [3, 0, 2, 0, 2, 1]
        assert part.hashes().tolist() == full.hashes()[3:7].tolist()
        assert (part.hashes()[:2] == part.hashes()[2:]).all() == lower


def likelihood(n, own, classes):
    member = np.eye(classes)[own]
    t = member.T @ n @ member
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_finds_the_classes():
    # units 1-6 and 7-12 alternate
    draw = np.random.default_rng(0)
    n = np.zeros((13, 13), np.int64)
    for a, b in itertools.product(range(1, 7), range(7, 13)):
        n[a, b], n[b, a] = draw.integers(20, 60, 2)
    n[0, 1:7] = n[7:, 0] = 5
    own = class_ngrams.exchange(n, 3)
    assert own[0] == 0 and len(set(own[1:7])) == 1 and len(set(own[7:])) == 1 and own[1] != own[7]


def test_exchange_stops_where_no_single_move_gains():
    draw = np.random.default_rng(2)
    n = draw.poisson(3, (9, 9))
    own = class_ngrams.exchange(n, 3, sweeps=50)
    best = likelihood(n, own, 3)
    for u, g in itertools.product(range(1, 9), (1, 2)):
        other = own.copy()
        other[u] = g
        assert likelihood(n, other, 3) <= best + 1e-6


def test_probabilities_add_up():
    draw = np.random.default_rng(1)
    pairs = draw.poisson(0.5, (class_ngrams.CLASSES, class_ngrams.CLASSES))
    assert np.allclose((10 ** class_ngrams.transitions(pairs, pairs.sum(0))).sum(1), 1)
    cls, count = draw.integers(1, class_ngrams.CLASSES, 900), draw.integers(1, 9, 900)
    totals = np.bincount(cls, count, class_ngrams.CLASSES)
    m = class_ngrams.Model(cls[:9], totals, np.bincount(cls, minlength=class_ngrams.CLASSES), int(count.sum()), 900)
    for g in range(1, class_ngrams.CLASSES):
        known = (10 ** m.emission(count[cls == g], cls[cls == g])).sum()
        unseen = 10 ** m.emission(np.zeros(1), np.array([g]))[0] * (m.class_words[g] + 1)
        assert known + unseen == pytest.approx(1)


def plain_model(rows):
    """The whole model but for the exchange, over dictionaries of words: {doc_id: score}."""
    c_n, discount, prior = class_ngrams.CLASSES, class_ngrams.DISCOUNT, class_ngrams.PRIOR
    from dayprint.llm.hashing import Words

    import pyarrow as pa

    texts = [(i, lowered(t).split(), zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    train = [w for _, w, held in texts if not held]
    counts = collections.Counter(x for w in train for x in w)
    coded = {x: int(Words(pa.array([x]), True).hashes().view(np.int64)[0]) for _, w, _ in texts for x in w}
    frequent = sorted(sorted(counts, key=lambda x: (-counts[x], coded[x]))[: class_ngrams.FREQUENT], key=coded.get)

    def ending(x):
        b = x.encode()
        return int(class_ngrams.mixed(np.array([(b[-2] if len(b) > 1 else 0) * 257 + b[-1] + 1], np.uint64))[0] % class_ngrams.ENDINGS)

    place = {x: 1 + class_ngrams.ENDINGS + k for k, x in enumerate(frequent)}
    unit = lambda x: 0 if x is None else place.get(x, 1 + ending(x))
    n = np.zeros((class_ngrams.UNITS, class_ngrams.UNITS), np.int64)
    for w in train:
        for a, b in itertools.pairwise([None, *w, None]):
            n[unit(a), unit(b)] += 1
    own = class_ngrams.exchange(n, c_n)
    seed = lambda x: own[unit(x)]
    contexts = collections.defaultdict(collections.Counter)
    for w in train:
        for a, x, b in zip([None, *w], w, [*w[1:], None]):
            if x not in place:
                contexts[x].update([seed(a), c_n + seed(b)])
    cls, before = None, None
    for _ in range(class_ngrams.ROUNDS):
        follows, precedes = np.zeros((c_n, c_n)), np.zeros((c_n, c_n))
        of = lambda x: seed(x) if cls is None else cls.get(x, seed(x))
        for w in train:
            for a, b in itertools.pairwise([None, *w, None]):
                follows[seed(a), of(b)] += 1
                precedes[of(a), seed(b)] += 1
        weights = class_ngrams.context_weights(follows, precedes)
        new, gain = {}, 0.0
        for x, context in contexts.items():
            score = [sum(k * weights[code, g] for code, k in context.items()) for g in range(1, c_n)]
            new[x] = 1 + int(np.argmax(score))
            gain += max(score)
        if before is not None and gain - before <= class_ngrams.SETTLED * abs(before):
            break
        cls, before = new, gain
    of = lambda x: cls.get(x, seed(x))
    total, kinds, pairs = np.zeros(c_n), np.zeros(c_n), np.zeros((c_n, c_n))
    for w in train:
        for a, b in itertools.pairwise([None, *w, None]):
            pairs[of(a), of(b)] += 1
            total[of(b)] += 1
    for x in counts:
        kinds[of(x)] += 1
    out = {}
    for i, w, _ in texts:
        score = 0.0
        for a, b in itertools.pairwise([None, *w, None]):
            g, h = of(a), of(b)
            score += math.log10((pairs[g, h] + prior * (total[h] + 1) / (total.sum() + c_n)) / (pairs[g].sum() + prior))
            if b is not None:
                known = max(counts[b] - discount, discount) if counts[b] else (discount * kinds[h] + 1) / (kinds[h] + 1)
                score += math.log10(known / (total[h] + 1))
        out[i] = score
    return out, cls


def test_score_equals_plain_model(spark, monkeypatch):
    """Small numbers of frequent words and of words in a bucket, so that most words are classed by their contexts."""
    for name, value in (("FREQUENT", 40), ("UNITS", 1 + class_ngrams.ENDINGS + 40), ("BUCKET_WORDS", 100)):
        monkeypatch.setattr(class_ngrams, name, value)
    draw = random.Random(4)
    groups = [[f"{a}{k}{b}" for k in range(90)] for a, b in (("n", "xa"), ("v", "xb"), ("d", "xc"))]
    rows = [(i, " ".join(draw.choice(groups[k % 3][: draw.choice((5, 20, 90))]) for k in range(draw.randint(0, 60)))) for i in range(150)]
    want, cls = plain_model(rows)
    assert len(cls) > 100
    got = {r["doc_id"]: r["score"] for r in class_ngrams.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_contexts_of_a_bucket_add_up(monkeypatch):
    """Contexts gathered in several steps and stored in several pieces."""
    monkeypatch.setattr(class_ngrams, "GATHERED", 50)
    monkeypatch.setattr(class_ngrams, "PIECE_WORDS", 7)
    draw = np.random.default_rng(3)
    want, batches = collections.Counter(), []
    for bucket in (0, 0, 0, 1, 1, 4):
        words = np.unique(draw.integers(-(2**62), 2**62, 3)[draw.integers(0, 3, 20)] + draw.integers(0, 9, 20))
        keys = np.unique(draw.integers(0, len(words), 60) * class_ngrams.PACK + draw.integers(0, 2 * class_ngrams.CLASSES, 60))
        # every word has a context
        keys = np.unique(np.concatenate([keys, np.arange(len(words)) * class_ngrams.PACK]))
        counts = draw.integers(1, 2**33, len(keys))
        for _ in range(2):
            want.update({(bucket, int(words[k // class_ngrams.PACK]), int(k % class_ngrams.PACK)): int(c) for k, c in zip(keys, counts)})
            batches.append(class_ngrams._rows(bucket, words, keys // class_ngrams.PACK, keys % class_ngrams.PACK, counts))
    got = collections.Counter()
    pieces = list(class_ngrams._added_contexts(batches))
    for piece in pieces:
        words, word, codes, counts = class_ngrams._read(piece, 0)
        assert len(words) <= 7
        for w, code, c in zip(words[word].tolist(), codes.tolist(), counts.tolist()):
            assert (piece.column("bucket")[0].as_py(), w, code) not in got
            got[piece.column("bucket")[0].as_py(), w, code] = c
    assert got == want and len(pieces) > 3


def test_model_beats_single_words(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = class_ngrams.scored(rows).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert r["s"] > r["b"]


@pytest.mark.parametrize("shares", [[1, 1], [3, 1], [5, 3, 2], [7, 7, 7, 1], [1, 2, 3, 4, 5, 6]])
def test_schedule_stays_within_one_block(shares):
    shares = np.array(shares)
    slots = fair_mix.one_period(shares)
    owner = {t: s for s, ts in enumerate(slots) for t in ts}
    assert sorted(owner) == list(range(shares.sum()))
    given = np.zeros(len(shares))
    for t in range(shares.sum()):
        given[owner[t]] += 1
        assert (np.abs(given - shares * (t + 1) / shares.sum()) < 1).all()


def test_whole_shares():
    got = fair_mix.whole_shares(np.array([0.5, 0.3, 0.2, 1e-9]), 1000)
    assert got.sum() == 1000 and got[3] == 1 and abs(got[0] - 500) <= 3


def test_phases_give_every_block_one_slot():
    blocks = {"a": 2500, "b": 40, "c": 700, "d": 0, "e": 1}
    plan = fair_mix.phases(blocks, {"a": 1.0, "b": 2.0, "c": 1.0, "d": 1.0, "e": 0.5})
    used = []
    for s, n in blocks.items():
        own = plan[s]
        for j in range(n):
            first, slot, period, slots = [p for p in own if p[0] <= j][-1]
            k = j - first
            used.append(slot + k // len(slots) * period + int(slots[k % len(slots)]))
    assert sorted(used) == list(range(sum(blocks.values())))


def test_mixture(spark, hard_docs, no_docs):
    turns = fair_mix.schedule(hard_docs, block=500).collect()
    rows = hard_docs.collect()
    assert len(turns) == len({(r["doc_id"], r["text"], r["source"]) for r in rows})
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in turns)
    starts = {}
    for r in turns:
        assert starts.setdefault((r["lane"], r["block"], r["place"]), r["doc_id"]) == r["doc_id"]
    slots = collections.defaultdict(set)
    for r in turns:
        slots[r["slot"]].add((r["lane"], r["block"]))
    assert all(len(x) == 1 for x in slots.values())
    for lane in {r["lane"] for r in turns}:
        mine = sorted((r for r in turns if r["lane"] == lane), key=lambda r: (r["block"], r["place"]))
        names = [-1 if r["doc_id"] is None else r["doc_id"] for r in mine]
        assert names == sorted(names) and [r["slot"] for r in mine] == sorted(r["slot"] for r in mine)
    mixed = fair_mix.mixed(hard_docs, block=500)
    assert mixed.columns == hard_docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, rows))
    assert fair_mix.schedule(no_docs).count() == 0 and fair_mix.mixed(no_docs).count() == 0


def test_mixture_follows_the_weights(spark):
    rows = [(i, "x" * 100, "big" if i % 4 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    turns = fair_mix.schedule(docs, {"big": 0.5, "small": 0.5}, block=1000).select("slot", "lane").distinct().orderBy("slot").collect()
    first = [r["lane"] for r in turns[:100]]
    for n in range(1, 101):
        assert abs(first[:n].count("small") - n / 2) <= 1
    assert [r["slot"] for r in turns] == list(range(400))


@pytest.mark.parametrize("weights", [[0.9, 0.1], [1 / 3, 2 / 3], [0.9, 0.09999, 1e-5], [0.3] + [0.7 / 499] * 499])
def test_long_schedules_keep_the_given_weights(weights):
    names = [f"s{i:03d}" for i in range(len(weights))]
    length = 30_000
    # every source outlasts the slots that are looked at
    plan = fair_mix.phases({s: int(length * w * 1.1) + 3 for s, w in zip(names, weights)}, dict(zip(names, weights)))
    owner = np.full(length, -1)
    for i, s in enumerate(names):
        for first, slot, period, slots in plan[s]:
            at = slot + slots
            owner[at[at < length]] = i
    assert (owner >= 0).all()
    until = np.arange(1, length + 1)
    for i in {0, 1, len(weights) - 1}:
        assert np.abs(np.cumsum(owner == i) - until * (weights[i] / sum(weights))).max() < 1 + 1e-6


def test_sources_of_weight_zero_come_last():
    got = fair_mix.turns({"a": 2, "b": 3}, {"a": 0.0, "b": 1.0})
    assert got["b"][:, 0].tolist() == [0, 1, 2] and got["a"][:, 0].tolist() == [3, 4]
    with pytest.raises(ValueError):
        fair_mix.turns({"a": 1}, {"a": -1.0})


def test_many_sources_are_all_scheduled(spark):
    rows = [(i * 10 + k, "x" * 100, f"site{i:04d}") for i in range(1200) for k in range(10 if i < 600 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"site{i:04d}": 5.0 if i % 7 == 0 else 1.0 for i in range(1200)}
    got = fair_mix.schedule(docs, weights, block=100).collect()
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows) and all(r["lane"] == source[r["doc_id"]] for r in got)
    assert sorted(r["slot"] for r in got) == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    order = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["slot"]):
        order[r["lane"]].append((r["block"], r["slot"]))
    assert all([b for b, _ in x] == list(range(len(x))) for x in order.values())
    # until a source ends, each one's blocks keep to its weight among all, also on shared tracks
    total = sum(weights.values())
    until = min(x[-1][1] for x in order.values()) + 1
    assert until > 500
    for s, x in order.items():
        given, w = np.zeros(until), weights[s] / total
        for _, slot in x:
            given[slot:] += 1
        assert np.abs(given - w * np.arange(1, until + 1)).max() < 1 + 5 / 500
    mixed = docs.selectExpr("doc_id", "text", "case doc_id % 3 when 0 then '' when 1 then 'a' end as source")  # empty and null are two sources
    assert sorted(r["slot"] for r in fair_mix.schedule(mixed, block=100).collect()) == list(range(len(rows)))
    alone = fair_mix.schedule(docs, {"site1199": 0.0}, block=100).where("lane = 'site1199'").selectExpr("min(slot) as a").first()
    first = fair_mix.schedule(docs, {"site1199": 1e6}, block=100).where("lane = 'site1199'").selectExpr("max(slot) as b").first()
    assert first["b"] < 10 < alone["a"]


@pytest.fixture(scope="module")
def graded(spark, prose_of):
    draw, rows = random.Random(2), []
    for i in range(400):
        good = i % 4 != 0
        text = prose_of(i, draw.randint(30, 120))
        rows.append((i, text if good else " ".join(w + draw.choice(["***", "$$$", "%%%"]) for w in text.split()), int(good)))
    return rows


def test_votes(spark, graded, hard_docs):
    docs = spark.createDataFrame([r[:2] for r in graded], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in graded], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in latent_votes.scored(docs, labels).collect()}
    held = [r for r in graded if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert [got[r[0]]["held_out"] for r in graded] == [r in held for r in graded]
    assert np.mean([(got[i]["score"] >= 0.3) == q for i, _, q in held]) > 0.97
    # labels of held-out rows are never read
    wrong = spark.createDataFrame([(r[0], (1 - r[2]) if r in held else r[2], 0) for r in graded], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in latent_votes.scored(docs, wrong).collect()}
    assert all(again[i] == pytest.approx(r["score"], abs=1e-9) for i, r in got.items())
    hard = latent_votes.scored(hard_docs, labels)
    assert hard.count() == hard_docs.count() and all(0 <= r["score"] <= 1 for r in hard.collect())


def test_votes_equal_brute_force(graded):
    import pyarrow as pa

    rows = latent_votes.term_counts(pa.array([r[1] for r in graded]))
    model = latent_votes.Model(np.ones(latent_votes.TERMS), rows[:300], np.array([r[2] for r in graded[:300]]))
    v = model.latent(rows)
    for i in range(300, 400):
        cos = np.array([float(v[i] @ v[j]) for j in range(300)])
        near = np.argsort(-cos, kind="stable")[: latent_votes.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** 4 + 1e-9
        want = (w * np.array([graded[j][2] for j in near])).sum() / w.sum()
        assert model.scores(rows[i : i + 1])[0] == pytest.approx(want, abs=0.05)


def test_votes_without_labels(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in latent_votes.scored(hard_docs, none).collect()} == {0.5}
    assert latent_votes.scored(no_docs, none).count() == 0


def test_mixing_keeps_the_number_of_rows(spark):
    """One text under two sources, repeated rows and null ids."""
    from dayprint.llm.fair_mix import mixed

    rows = [(1, "same", "a"), (1, "same", "b"), (1, "same", None), (2, "x", "a"), (2, "x", "a"), (None, "y", "a"), (None, "y", "b"), (None, None, "a"), (None, None, None)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
