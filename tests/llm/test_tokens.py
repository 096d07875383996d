"""Token files and packing against the tokenizers library, plain best-fit decreasing and exact round trips."""

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayprint.llm.best_fit import CapacityTree, layout, pack
from dayprint.llm.catalogue import vocabulary
from dayprint.llm.rans_files import token_files
from dayprint.llm.rans_format import CHECKPOINT, LANES, Table, decode, encode
from dayprint.llm.words import tokenizer


def library_ids(text):
    return tokenizer(vocabulary()).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_cache_equals_library(texts):
    ids, n = tokenizer(vocabulary()).encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(library_ids(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library_ids(t)]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|startoftext|>b", "don't I'LL'd", "ẖ H̱ İ ΑΣ", "x y z", "a\x1cb", "1st 2nd", "--- ...!!", "日本語 テスト。"])
def test_awkward_words(text):
    assert tokenizer(vocabulary()).encode(pa.array([text]))[0].tolist() == library_ids(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=4 * LANES), min_size=1, max_size=5))
def test_rans_round_trip(blocks):
    flat = np.concatenate([np.array(b) for b in blocks])
    table = Table(*np.unique(flat, return_counts=True))
    given_blocks = [(np.array(b, np.uint32), [(None if k == 1 else k, 7, len(b))]) for k, b in enumerate(blocks)]
    for (ids, docs), (want, names) in zip(decode(table, encode(table, given_blocks)), given_blocks):
        assert ids.tolist() == want.tolist() and docs == names


def test_rans_checkpoints_size_and_damage():
    draw = np.random.default_rng(0)
    ids = np.minimum(draw.geometric(0.02, LANES * CHECKPOINT * 2 + 77), 400).astype(np.uint32)
    table = Table(*np.unique(ids, return_counts=True))
    (raw,) = encode(table, [(ids, [(1, 0, len(ids))])])
    assert (decode(table, [raw])[0][0] == ids).all()
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(raw) < 1.03 * len(ids) * -(p * np.log2(p)).sum() / 8 + 2000
    with pytest.raises(ValueError, match="damaged"):
        decode(table, [raw[:500] + bytes([raw[500] ^ 1]) + raw[501:]])
    with pytest.raises(ValueError, match="frequency table"):
        encode(table, [(np.array([9999], np.uint32), [(1, 0, 1)])])


def test_token_files(hard_docs, no_docs):
    got = sorted(token_files(hard_docs, vocabulary(), 2).collect(), key=lambda r: r["start"])
    rows = hard_docs.collect()
    assert len(got) == len(rows)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(np.array(library_ids(r["text"]) + [2], "<u4").tobytes())) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == (np.cumsum([r["n_tokens"] for r in got]) - [r["n_tokens"] for r in got]).tolist()
    names = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert names == sorted(names)
    assert token_files(no_docs, vocabulary(), 2).count() == 0


def plain_best_fit(lengths, capacity):
    open_bins, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(open_bins, x)
        left = open_bins.pop(k) if k < len(open_bins) else capacity
        n += left == capacity
        if left > x:
            bisect.insort(open_bins, left - x)
    return n


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=200), st.integers(40, 70))
def test_layout_is_best_fit_decreasing(lengths, capacity):
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    used, placed = {}, 0
    rows = layout(counts, capacity).tolist()
    for k, (length, rank, first, offset, per) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        for r in range(end - rank):
            used.setdefault(first + r // per, []).append((offset + r % per * length, length))
            placed += 1
    assert placed == len(lengths)
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_capacity_tree():
    tree = CapacityTree(100)
    assert tree.tightest(1) is None
    for c in (7, 30, 100):
        tree.mark(c, True)
    assert [tree.tightest(n) for n in (1, 7, 8, 31, 100)] == [7, 7, 30, 100, 100]
    tree.mark(30, False)
    assert tree.tightest(8) == 100


def test_pack(hard_docs, no_docs):
    rows = pack(hard_docs, vocabulary()).toPandas()
    texts = hard_docs.collect()
    total = sum(len(library_ids(r["text"])) + 1 for r in texts)
    assert rows["length"].sum() == total and rows["length"].max() <= 2048
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.cumsum(seq["length"]) - seq["length"]).all() and seq["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() == plain_best_fit(rows["length"].tolist(), 2048)
    long = rows[rows["doc_id"] == 6].sort_values("piece")
    assert np.frombuffer(b"".join(long["ids"]), "<u4").tolist() == library_ids(next(r["text"] for r in texts if r["doc_id"] == 6)) + [0]
    assert pack(no_docs, vocabulary()).count() == 0


def test_plain_words_with_marks_equal_the_library():
    """Words that are cut as a column: letters, one mark, several marks, marks alone, and what looks like them."""
    from tokenizers import Tokenizer

    from dayprint.llm.words import WordTokenizer

    coder, library = WordTokenizer(vocabulary()), Tokenizer.from_file(vocabulary())
    texts = ["", None, "Word word, WORD. word! word? word; word: a, I", "word,, word.!? ... , , x1, 1. it's, don't. É, été. <|endoftext|>.", "q" * 5000 + ",", "\t \n", "a.b, c,d ,e"]
    for batch in (texts, texts[::-1], [], [None], [""]):
        ids, n = coder.encode(pa.array(batch, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in batch]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
