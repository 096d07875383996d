"""Ranked lexical search by Block-Max MaxScore over shards of documents.

Documents become rows of (term, occurrences) for the terms that items ask for. Each task cuts its documents into shards
and writes one row for each shard: inverted lists in blocks of 128 postings, gaps and occurrences in bytes with the
larger values set aside, the highest score of each list and of each block. A query takes a shard window by window. Lists
whose bounds together stay below the 50th score so far are not essential: only documents of the other lists become
candidates, block maxima of the non-essential lists reject candidates, and only blocks that still matter are decoded.
The heaps of all shards are merged by one window over (item, score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayprint.llm.hashing import Words, spread
from dayprint.llm.store import BROADCAST_BYTES, dropped, stored
from dayprint.llm.words import give_back

#: Characters that end a term: all of ASCII but digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
BLOCK = 128
#: A shard ends at this many documents (places fit in 16 bits) or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Documents that a query takes at once; the threshold rises from window to window.
WINDOW = 4096
#: Text bytes handled at once; longer texts are cut at the end of a term.
PIECE_BYTES = 2 << 20
#: Bytes of an (item, term) pair or a term in the broadcast queries, at most about.
PAIR_BYTES = 64


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and texts of about `most` bytes together; a longer text comes in several pieces, cut between terms."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + size[to] <= most):
            total += int(size[to])
            to += 1
        if to - at > 1 or total <= most:
            yield np.arange(at, to), texts.slice(at, to - at)
        else:
            raw = texts[at].as_buffer()
            letter = LETTERS[np.frombuffer(raw, np.uint8)]
            begin = 0
            while begin < total:
                end = min(total, begin + most)
                while end < total and letter[end]:
                    gap = np.flatnonzero(~letter[end : end + most])
                    end = end + int(gap[0]) if len(gap) else min(total, end + most)
                yield np.array([at]), pa.array([raw[begin:end].to_pybytes()], pa.binary()).cast(pa.string())
                begin = end
        at = to


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts in order, and how many each text has."""
    words = Words(texts, lower=True, letters=LETTERS)
    return words.hashes(), words.n


def _counted(keys):
    def run(batches):
        known = keys.value
        width = max(1, len(known))
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            parts = []
            for rows, texts in pieces(batch.column("text")):
                h, per_text = term_hashes(texts)
                np.add.at(n, rows, per_text)
                at = np.minimum(np.searchsorted(known, h), width - 1)
                met = known[at] == h if len(known) else np.zeros(len(h), bool)
                code, tf = np.unique(np.repeat(rows, per_text)[met] * width + at[met], return_counts=True)
                parts.append((code, tf))
            code = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            tf = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            code, back = np.unique(code, return_inverse=True)
            tf = np.bincount(back, tf, len(code)).astype("<i4")
            doc, term = code // width, (code % width).astype("<i4")
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            lists = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), lists(term), lists(tf)], ["doc_id", "n", "terms", "tfs"])
            give_back()

    return run


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _totals(width: int):
    """Documents that hold each term; under -1 the documents with terms, under -2 all their terms."""

    def run(batches):
        df, docs, terms = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_joined(batch.column("terms"), "<i4"), minlength=width)
            n = batch.column("n").to_numpy()
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([docs, terms, *df[some].tolist()], pa.int64())], ["term", "n"])

    return run


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count brings for each unit of a term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in bytes, and the places and values of those that need more."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), large.astype("<i8"), values[large].astype("<i8")


def unpacked(low: np.ndarray, places: np.ndarray, large: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = low[at].astype(np.int64)
    more = out == 255
    if more.any():
        out[more] = large[np.searchsorted(places, at[more])]
    return out


FIELDS = {
    "doc_ids": "<i8", "nulls": "?", "m": "<i8", "terms": "<i4", "list_at": "<i8", "block_at": "<i8", "list_max": "<i8",
    "first": "<i8", "last": "<i8", "block_max": "<i8", "gaps": "u1", "gap_at": "<i8", "gap_large": "<i8", "tfs": "u1", "tf_at": "<i8", "tf_large": "<i8",
}


class Shard:
    """Inverted lists of some documents; places of documents rise with doc_id."""

    def __init__(self, fields: dict[str, np.ndarray]):
        self.__dict__.update(fields)

    @classmethod
    def built(cls, doc_ids: np.ndarray, nulls: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> Shard:
        order = np.lexsort((doc_ids, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = place[doc], term.astype(np.int64), tf.astype(np.int64)
        by = np.argsort(term * len(order) + doc, kind="stable")
        doc, term, tf = doc[by], term[by], tf[by]
        m = m[order]
        score = weights[term] * shares(tf, m[doc])
        terms, list_at = np.unique(term, return_index=True)
        lengths = np.diff(np.append(list_at, len(doc)))
        blocks = -(-lengths // BLOCK)
        block_at = np.concatenate([[0], np.cumsum(blocks)])
        begins = np.repeat(list_at, blocks) + BLOCK * (np.arange(block_at[-1]) - np.repeat(block_at[:-1], blocks))
        ends = np.append(begins[1:], len(doc))[: len(begins)]
        gaps = np.diff(doc, prepend=0)
        gaps[begins] = 0
        most = lambda at: np.maximum.reduceat(score, at) if len(at) else score[:0]
        g, t = packed(gaps), packed(tf)
        return cls({
            "doc_ids": doc_ids[order], "nulls": nulls[order], "m": m, "terms": terms, "list_at": np.append(list_at, len(doc)), "block_at": block_at, "list_max": most(list_at),
            "first": doc[begins], "last": doc[ends - 1], "block_max": most(begins), "gaps": g[0], "gap_at": g[1], "gap_large": g[2], "tfs": t[0], "tf_at": t[1], "tf_large": t[2],
        })

    def row(self) -> list[bytes]:
        return [getattr(self, f).astype(k).tobytes() for f, k in FIELDS.items()]

    def decoded(self, k: int, blocks: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents and their scores in the given blocks (counted within list k)."""
        begin = self.list_at[k] + blocks * BLOCK
        n = np.minimum(begin + BLOCK, self.list_at[k + 1]) - begin
        at = spread(begin, n)
        steps = np.cumsum(unpacked(self.gaps, self.gap_at, self.gap_large, at))
        head = np.cumsum(n) - n
        doc = steps + np.repeat(self.first[self.block_at[k] + blocks] - steps[head], n)
        return doc, weight * shares(unpacked(self.tfs, self.tf_at, self.tf_large, at), self.m[doc])


class Best:
    """The k best of one item so far."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        keep = scores >= self.floor
        if not keep.any():
            return
        both = lambda old, new: np.concatenate([old, new[keep]])
        s, i, n = both(self.scores, scores), both(self.ids, ids), both(self.nulls, nulls)
        first = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.nulls = s[first], i[first], n[first]
        if len(first) == self.k:
            self.floor = int(self.scores[-1])


def searched(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Bring the shard's documents into `best`; tells how many postings were decoded."""
    at = np.searchsorted(shard.terms, terms)
    here = at < len(shard.terms)
    here[here] = shard.terms[at[here]] == terms[here]
    lists = at[here]
    lists = lists[shard.list_max[lists] > 0]
    if not len(lists):
        return 0
    lists = lists[np.argsort(shard.list_max[lists], kind="stable")]
    bound = np.cumsum(shard.list_max[lists])
    weight = weights[shard.terms[lists]]
    spans = [slice(shard.block_at[k], shard.block_at[k + 1]) for k in lists]
    work = 0
    for low in range(0, len(shard.m), WINDOW):
        high = min(low + WINDOW, len(shard.m))
        slack = int(np.searchsorted(bound, best.floor, "left"))  # lists 0..slack-1 together stay below the threshold
        if slack == len(lists):
            return work
        total = np.zeros(high - low, np.int64)
        for j in range(slack, len(lists)):
            blocks = np.arange(np.searchsorted(shard.last[spans[j]], low), np.searchsorted(shard.first[spans[j]], high))
            if len(blocks):
                doc, score = shard.decoded(lists[j], blocks, weight[j])
                work += len(doc)
                a, b = np.searchsorted(doc, [low, high])
                total[doc[a:b] - low] += score[a:b]
        found = np.flatnonzero(total)
        score, found = total[found], found + low
        if slack and len(found):
            keep = score + bound[slack - 1] >= best.floor
            score, found = score[keep], found[keep]
            where, most = np.zeros((slack, len(found)), np.int64), np.zeros((slack, len(found)), np.int64)
            for j in range(slack):
                b = np.searchsorted(shard.last[spans[j]], found)
                inside = b < spans[j].stop - spans[j].start
                inside[inside] = shard.first[spans[j]][b[inside]] <= found[inside]
                where[j], most[j, inside] = b, shard.block_max[spans[j]][b[inside]]
            for j in range(slack - 1, -1, -1):
                keep = score + most[: j + 1].sum(0) >= best.floor
                score, found, where, most = score[keep], found[keep], where[:, keep], most[:, keep]
                asked = most[j] > 0
                if asked.any():
                    doc, gain = shard.decoded(lists[j], np.unique(where[j][asked]), weight[j])
                    work += len(doc)
                    p = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                    score = score + np.where(doc[p] == found, gain[p], 0)
        best.add(score, shard.doc_ids[found], shard.nulls[found])
    return work


def _indexed(shared):
    def run(batches):
        weights, n_docs, n_terms = shared.value
        held: list[tuple] = []

        def flushed():
            ids, nulls, n, term, tf = (np.concatenate(x) for x in zip(*(h[:5] for h in held)))
            counts = np.concatenate([h[5] for h in held])
            doc = np.repeat(np.arange(len(ids)), counts)
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            shard = Shard.built(ids, nulls, m, doc, term, tf, weights)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row()], list(FIELDS))

        for batch in batches:
            at = 0
            ids = batch.column("doc_id")
            sizes = pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4
            while at < batch.num_rows:
                room = SHARD_POSTINGS - sum(int(h[5].sum()) for h in held)
                spare = SHARD_DOCS - sum(len(h[0]) for h in held)
                upto = min(batch.num_rows, at + spare, at + int(np.searchsorted(np.cumsum(sizes[at:]), room, "right")))
                if upto == at and not held:
                    upto = at + 1
                if upto > at:
                    part = batch.slice(at, upto - at)
                    held.append((
                        pc.fill_null(ids.slice(at, upto - at), 0).to_numpy(zero_copy_only=False), ids.slice(at, upto - at).is_null().to_numpy(zero_copy_only=False),
                        part.column("n").to_numpy(), _joined(part.column("terms"), "<i4"), _joined(part.column("tfs"), "<i4"), sizes[at:upto],
                    ))
                if upto < batch.num_rows or upto == at:
                    yield flushed()
                at = upto
        if held:
            yield flushed()

    return run


def _heaps(shared, k: int):
    def run(batches):
        weights, items = shared.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({f: np.frombuffer(batch.column(f)[row].as_buffer(), kind) for f, kind in FIELDS.items()})
                for (_, terms), b in zip(items, best):
                    searched(shard, terms, weights, b)
        for (item, _), b in zip(items, best):
            if len(b.scores):
                ids = pa.array(b.ids, mask=b.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), item, np.int64)), ids, pa.array(b.scores)], ["item_id", "doc_id", "score"])

    return run


def index_terms(docs: DataFrame, terms: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written shards of an index of (doc_id, text) for the given distinct terms, the weights by term number, and the terms' numbers.

    Statistics cover all documents; a term that no document holds has weight 0.
    """
    spark = docs.sparkSession
    hashes = term_hashes(pa.array(terms, pa.string()))[0] if terms else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    keys = spark.sparkContext.broadcast(hashes[order])
    counted = stored(docs.select("doc_id", "text").mapInArrow(_counted(keys), "doc_id long, n long, terms binary, tfs binary"), "counted")
    totals = counted.select("n", "terms").mapInArrow(_totals(len(terms)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.col("docs") + 2) / (2 * F.col("n") + 1))).cast("long")
    # one row for each term asked for, and two
    got = {r["term"]: r["n"] for r in totals.collect()}
    n_docs, n_terms = got.pop(-1, 0), got.pop(-2, 0)
    by_key = np.zeros(len(terms), np.int64)
    if got:
        rows = spark.createDataFrame([(t, n, n_docs) for t, n in got.items()], "term long, n long, docs long").select("term", weight.alias("w")).collect()
        for r in rows:
            by_key[r["term"]] = r["w"]
    shared = spark.sparkContext.broadcast((by_key, n_docs, n_terms))
    held = counted.where("n > 0").mapInArrow(_indexed(shared), ", ".join(f"{f} binary" for f in FIELDS))
    index = stored(held, "shards")
    dropped(spark, counted)
    back = np.empty(len(terms), np.int64)
    back[order] = np.arange(len(terms))
    return index, by_key, back


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text).

    Null texts have no terms; a document or item without terms is in no result. Rows under one item_id are one item with
    all their terms, rows with a null item_id are none. Every row of docs is a document, also repeated ones and those with
    a null doc_id, which come after all others of the same score. Further columns are ignored; empty tables give an empty
    result. Terms are told apart by 64-bit hashes. Long texts are cut between terms, so that memory grows with a text's bytes
    alone. Items are taken in blocks whose terms fit the bound of a broadcast.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    asked = stored(asked, "asked")
    blocks = -(-asked.count() * PAIR_BYTES // BROADCAST_BYTES)
    out = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        pairs = mine.collect()  # at most about BROADCAST_BYTES, see `blocks`
        terms = sorted({r["term"] for r in pairs})
        index, weights, back = index_terms(docs, terms)
        number = dict(zip(terms, back.tolist()))
        lists: dict[int, list[int]] = {}
        for r in pairs:
            lists.setdefault(r["item_id"], []).append(number[r["term"]])
        shared = spark.sparkContext.broadcast((weights, [(i, np.array(sorted(t))) for i, t in sorted(lists.items())]))
        heaps = index.mapInArrow(_heaps(shared, k), "item_id long, doc_id long, score long")
        out = heaps if out is None else out.union(heaps)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
