"""The pipeline's stages on hard rows and against a brute-force run."""

import re

import numpy as np

import corpus_pipeline as p
from dayprint.llm.catalogue import vocabulary
from dayprint.llm.words import tokenizer


def test_stages_on_hard_rows(spark, hard_docs, no_docs):
    for docs in (hard_docs, no_docs):
        for name, stage in p.STAGES:
            out = stage(spark, docs, "")
            if name != p.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            out.collect()


def test_every_stage_takes_effect(spark, hard_docs):
    docs = hard_docs
    left = []
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        left.append(sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect()))
    assert left[0] == [-1, 0, 1, 2, 6, 7, 10, 12, 13, 13] and left[1] == left[2] == left[3] == [-1, 0, 6, 10, 12]


def brute(rows):
    """doc_id -> text of what the stages before packing keep."""

    def good(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars = len(w), sum(map(len, w))
        win = [tuple(w[i : i + 5]) for i in range(n - 4)]
        seen, twice = set(), set()
        for x in win:
            (twice if x in seen else seen).add(x)
        cover = {i + k for i, x in enumerate(win) if x in twice for k in range(5)}
        lines = t.split("\n")
        full = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
        bad = n < 10 or 100 * len(cover) > 20 * n or 10 * len(re.findall(r"[#*$%&|<>]", t)) > n or not 2 * n <= chars <= 20 * n
        return not bad and 2 * sum(c.isupper() for c in t) <= chars and 2 * (len(full) - len(set(full))) <= len(lines)

    rows = {i: t for i, t in rows if good(t)}
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(rows)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: rows[i] for i in names if root(i) == i}


def test_run_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(docs)
    got = p.run(spark, folder).toPandas()
    assert set(got["doc_id"]) == set(want)
    plain = 0
    for i, pieces in got.groupby("doc_id"):
        ids = np.frombuffer(b"".join(pieces.sort_values("piece")["ids"]), "<u4").tolist()
        same = ids == tokenizer(vocabulary()).library.encode(want[i], add_special_tokens=False).ids + [0]
        plain += same
        assert same or re.search(r"(?i)token|secret|password|AKIA|[0-9a-f]{16}", want[i])
    assert plain > 0.9 * len(want)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.cumsum(seq["length"]) - seq["length"]).all() and seq["length"].sum() <= 2048
