"""Quality scores by nearest-neighbour votes in a latent-semantic space.

Terms are hashed byte trigrams, which weigh log(1 + n) times their inverse document frequency over all documents, and
levels of four shares of the text (distinct words, signs, capitals, length) of fixed weight. The latent directions are
the leading singular vectors of the labelled sample's term matrix; its documents' unit vectors are broadcast with
their labels (at most FIT_ROWS times DIMENSIONS numbers). Every document is compared with all of them by blocked matrix
products, and its NEIGHBOURS nearest ones vote, weighted by their cosine.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayprint.llm.hashing import CHUNK_BYTES, Words
from dayprint.llm.store import dropped, stored
from dayprint.llm.words import chunks

BUCKETS = 2048
LEVELS = 8
SHARES = 4
TERMS = BUCKETS + LEVELS * SHARES
#: Labelled documents that the classifier is fitted on, at most.
FIT_ROWS = 6000
DIMENSIONS = 64
NEIGHBOURS = 25
#: Weight of a level against a trigram that occurs once.
LEVEL_WEIGHT = 12.0
#: Documents whose dense term rows are held at once.
ROWS_AT_ONCE = 1000


def _share_levels(words: Words) -> np.ndarray:
    raw = words.raw
    size = np.diff(words.offsets)
    doc = np.repeat(np.arange(len(words.n)), size)
    letters = ((raw | 32) - np.uint8(97)) < 26
    high = raw >= 128
    capitals = (raw >= 65) & (raw <= 90)
    digits = (raw >= 48) & (raw <= 57)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    signs = ~(letters | high | digits | space | np.isin(raw, np.frombuffer(b".,", np.uint8)))
    count = lambda mask: np.bincount(doc[mask], minlength=len(words.n))
    h = words.hashes()
    of = np.repeat(np.arange(len(words.n)), words.n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[fresh], minlength=len(words.n))
    n = np.maximum(words.n, 1)
    # how far the distinct words fall short of the usual growth with the length
    variety = np.where(words.n > 0, distinct / n * (1 + 0.08 * np.log2(n)), 0)
    body = np.maximum(count(~space), 1)
    short = np.minimum(words.n, 64) / 64
    return np.stack([np.clip(variety, 0, 0.999), np.minimum(count(signs) / body * 4, 0.999), np.minimum(count(capitals) / body * 2, 0.999), np.minimum(short, 0.999)], 1)


def term_counts(texts: pa.Array) -> np.ndarray:
    """A dense row of weighted term counts (before the document frequencies) for each text; empty texts have levels only."""
    words = Words(texts)
    raw = words.raw.astype(np.uint32)
    edges = words.offsets
    size = np.diff(edges)
    n = np.maximum(size - 2, 0)
    doc = np.repeat(np.arange(len(size)), n)
    at = np.repeat(edges[:-1] - (np.cumsum(n) - n), n) + np.arange(len(doc))
    code = raw[at] * np.uint32(0x9E3779B1) + raw[at + 1] * np.uint32(0x85EBCA77) + raw[at + 2] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    bucket = (code >> np.uint32(32 - 11)).astype(np.int64)
    rows = np.zeros((len(size), TERMS), np.float32)
    counts = np.bincount(doc * BUCKETS + bucket, minlength=len(size) * BUCKETS).reshape(len(size), BUCKETS)
    rows[:, :BUCKETS] = np.log1p(counts)
    level = (_share_levels(words) * LEVELS).astype(int)
    for k in range(SHARES):
        rows[np.arange(len(size)), BUCKETS + k * LEVELS + level[:, k]] = LEVEL_WEIGHT
    return rows


def _slices(batch: pa.RecordBatch):
    for piece in chunks(batch, "text", CHUNK_BYTES):
        for at in range(0, piece.num_rows, ROWS_AT_ONCE):
            yield piece.slice(at, ROWS_AT_ONCE)


def _frequencies(batches):
    total, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for piece in _slices(batch):
            total += (term_counts(piece.column("text")) > 0).sum(0)
            n += piece.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(TERMS + 1), pa.int64()), pa.array([*total, n], pa.int64())], ["term", "n"])


def _sparse(batches):
    for batch in batches:
        for piece in _slices(batch):
            rows = term_counts(piece.column("text"))
            raws = []
            for r in rows:
                k = np.flatnonzero(r)
                raws.append(k.astype("<u2").tobytes() + r[k].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(raws, pa.binary())], ["doc_id", "label", "terms"])


class Model:
    """Inverse document frequencies, latent directions, the labelled documents' unit vectors and their labels."""

    def __init__(self, idf: np.ndarray, rows: np.ndarray, labels: np.ndarray, seed: int = 2):
        self.idf = idf.astype(np.float32)
        x = self.weighted(rows)
        # randomised range finder with two power rounds, then the small problem
        draw = np.random.default_rng(seed)
        width = min(DIMENSIONS + 16, *x.shape) if len(x) else 1
        q = draw.standard_normal((x.shape[1], width)).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(x.T @ (x @ q)) if len(x) else (q, None)
        if len(x):
            small = x @ q
            values, turn = np.linalg.eigh(small.T @ small)
            q = q @ turn[:, np.argsort(-values)[:DIMENSIONS]]
        self.directions = q[:, :DIMENSIONS].astype(np.float32)
        self.vectors, self.labels = self.latent(rows), labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        x = rows * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = self.weighted(rows) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosines = self.latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 4 + 1e-9
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def _scored(shared):
    def run(batches):
        for batch in batches:
            for piece in _slices(batch):
                score = shared.value.scores(term_counts(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def remainder(doc_id, of: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> Model:
    """The model learnt from labelled documents outside fold 0; frequencies come from all documents."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.set_index("term")["n"].reindex(range(TERMS + 1), fill_value=0).to_numpy()
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1
    idf[BUCKETS:] = 1.0
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    total = known.count()
    # rows are drawn by a hash of doc_id; the bound on their number is FIT_ROWS
    share = int(min(1.0, 0.95 * FIT_ROWS / max(total, 1)) * 1_000_000)
    drawn = stored(known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share).limit(FIT_ROWS), "drawn")
    rows = texts.join(F.broadcast(drawn), "doc_id").mapInArrow(_sparse, "doc_id long, label double, terms binary")
    rows = stored(rows, "terms")
    got = rows.orderBy("doc_id").limit(FIT_ROWS).toPandas()
    dense = np.zeros((len(got), TERMS), np.float32)
    for r, raw in zip(dense, got["terms"]):
        n = len(raw) // 6
        r[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    dropped(docs.sparkSession, drawn, rows)
    return Model(idf, dense, got["label"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) of every row of (doc_id, text).

    Null and empty texts are scored by their levels alone. Repeated rows are scored alike; several labels of a document
    count as their largest; without labels every score is 0.5; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label, folds))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_scored(model), "doc_id long, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "score")


def crc_remainder(doc_id: int, of: int) -> int:
    """The same remainder outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % of
