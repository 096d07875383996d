"""Repeated spans over all documents: a compacted De Bruijn graph of word windows.

A window is 50 consecutive words. Each window has a minimiser, the least hash of its 20-word k-mers; consecutive windows
of a document with the same minimiser form one edge of the graph, a stretch of text known by a 128-bit digest. Equal
windows have equal minimisers, so only minimisers that occur in two documents matter, and the rest is dropped first.

1. Edges that are the only successor and predecessor of each other in every document lie on a nonbranching path. Paths
   are compacted by pointer-doubling joins; all documents with one edge of a path have the whole path, so the path's
   source is the least such document, and the path's repeats in other documents are spans to remove.
2. Where different edges share a minimiser (a span begins, ends or changes), the windows of the edges' source documents
   are digested at their coordinates and compared one by one.

What is a repeat is decided by digests of whole windows or whole edges, never by the minimisers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayprint.llm.hashing import CHUNK_BYTES, Words, mixed, powers, rolling, spread
from dayprint.llm.store import BROADCAST_BYTES, dropped, stored
from dayprint.llm.words import chunks

WINDOW = 50
KMER = 20
SALT = np.uint64(0x2545F4914F6CDD1D)
LAST = (1 << 63) - 1


def _least_kmers(kmers: np.ndarray, n: int) -> np.ndarray:
    """For each place the place of the least of n k-mers from there on, the leftmost of equal ones."""
    best, at, width = kmers, np.arange(len(kmers), dtype=np.int64), 1
    while width < n:
        step = min(width, n - width)
        left, right = best[: len(best) - step], best[step:]
        right_wins = right < left
        best = np.where(right_wins, right, left)
        at = np.where(right_wins, at[step:], at[: len(at) - step])
        width += step
    return at


class Digests:
    """Two independent 64-bit hashes of any stretch of words."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = powers(len(hashes) + 1)
        self.sums = []
        for h in (hashes, mixed(hashes ^ SALT)):
            s = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * self.up[: len(h)], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        size = mixed(np.asarray(n).astype(np.uint64) + np.uint64(1))
        return [mixed((s[start + n] - s[start]) * self.down[start] ^ size).view(np.int64) for s in self.sums]


def _edges(batches):
    for batch in batches:
        for piece in chunks(batch, "text", CHUNK_BYTES):
            words = Words(piece.column("text"))
            h = words.hashes()
            windows = np.maximum(words.n - WINDOW + 1, 0)
            names = ["minimiser", "doc_id", "text_key", "at", "n", "digest", "digest2"]
            if not windows.any():
                continue
            place = _least_kmers(rolling(h, KMER), WINDOW - KMER + 1)
            kmers = rolling(h, KMER)
            start = spread(words.first, windows)
            doc = np.repeat(np.arange(len(windows)), windows)
            mine = place[start]
            fresh = np.ones(len(start), bool)
            fresh[1:] = (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(fresh)
            n = np.diff(np.append(first, len(start)))
            one, two = Digests(h).of(start[first], n + WINDOW - 1)
            rows = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kmers[mine[first]].view(np.int64)),
                    piece.column("doc_id").take(rows),
                    piece.column("text_key").take(rows),
                    pa.array(start[first] - words.first[doc[first]], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(one),
                    pa.array(two),
                ],
                names,
            )


def _windows(batches):
    """Digests of the windows asked for: `spans` lists the first window and the number of windows."""
    for batch in batches:
        for piece in chunks(batch, "text", CHUNK_BYTES):
            words = Words(piece.column("text"))
            digests = Digests(words.hashes())
            spans = piece.column("spans")
            at, n = (spans.flatten().field(k).to_numpy() for k in ("at", "n"))
            doc = np.repeat(np.arange(len(words.n)), spans.value_lengths().to_numpy())
            start = spread(at, n)
            doc = np.repeat(doc, n)
            one, two = digests.of(words.first[doc] + start, np.full(len(doc), WINDOW))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), piece.column("doc_id").take(rows), piece.column("text_key").take(rows), pa.array(start, pa.int64())],
                ["digest", "digest2", "doc_id", "text_key", "at"],
            )


def _without(batches):
    for batch in batches:
        for piece in chunks(batch, "text", CHUNK_BYTES):
            total, gone, kept = [], [], []
            for text, spans in zip(piece.column("text"), piece.column("spans").to_pylist()):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if spans:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        cover[s["at"]] += 1
                        cover[s["at"] + s["n"] + WINDOW - 1] -= 1
                    stay = np.cumsum(cover)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            columns = [piece.column(c) for c in piece.schema.names if c not in ("text", "spans", "doc_key", "text_key")]
            names = [c for c in piece.schema.names if c not in ("text", "spans", "doc_key", "text_key")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept_text"]
            )


def _keyed(docs: DataFrame) -> DataFrame:
    """A null doc_id counts as the largest; rows with one doc_id are told apart by their text."""
    return docs.withColumns({"doc_key": F.coalesce(F.col("doc_id"), F.lit(LAST)), "text_key": F.xxhash64("text")})


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """`spans` (doc_key, text_key, at, n) as an array on each document, by a shuffle of both: spans grow with the corpus."""
    lists = stored(spans.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    return _keyed(docs).join(lists.hint("shuffle_merge"), ["doc_key", "text_key"], how)


def paths(occurrences: DataFrame) -> DataFrame:
    """(digest, digest2, head, head2, n_path): each edge's path, named by its first edge, with the path's windows.

    `occurrences` are edges (doc_id, text_key, at, n, digest, digest2) that occur in two documents or more.
    """
    order = Window.partitionBy("doc_id", "text_key").orderBy("at")
    key = F.struct("digest", "digest2")
    near = occurrences.select(
        key.alias("edge"), "n",
        F.when(F.lead("at").over(order) == F.col("at") + F.col("n"), F.lead(key).over(order)).alias("after"),
        F.when(F.lag("at").over(order) + F.lag("n").over(order) == F.col("at"), F.lag(key).over(order)).alias("before"),
    )

    def only(c: str):
        alike = (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
        return F.when(alike, F.min(c)).alias(c)

    edges = stored(near.groupBy("edge").agg(F.first("n").alias("n"), only("after"), only("before")), "graph")
    link = edges.where("before is not null").alias("e").join(edges.alias("p"), F.col("e.before") == F.col("p.edge"))
    link = link.where("p.after = e.edge and e.edge <> p.edge").select(F.col("e.edge").alias("edge"), F.col("e.before").alias("to"))
    now = stored(edges.join(link, "edge", "left").select("edge", "n", F.coalesce("to", "edge").alias("to"), F.col("to").isNull().alias("done"), F.lit(0).cast("long").alias("behind")).where("not done"), "walk")
    settled = [edges.join(link, "edge", "left_anti").select("edge", "n", F.col("edge").alias("head"))]
    # `to` is 2**k edges back, or the head; an edge is done when `to` is a head. Cycles never end and stay as single edges.
    left, rounds = now.count(), 0
    heads = stored(settled.pop(), "heads")
    done = heads.select("edge", "n", "head")
    while left and 1 << rounds <= 2 * left:
        there = done.select(F.col("edge").alias("to"), "head")
        reached = now.join(there, "to").select("edge", "n", "head")
        step = now.select(F.col("edge").alias("to"), F.col("to").alias("further"))
        on = now.join(step, "to").select("edge", "n", F.col("further").alias("to"))
        done, before, now = stored(done.union(reached), "reached"), now, stored(on, "walk")
        dropped(edges.sparkSession, before)
        fewer = now.count()
        if not fewer:
            left = 0
            break
        left, rounds = fewer, rounds + 1
    whole = done.union(now.select("edge", "n", F.col("edge").alias("head"))) if left else done
    sums = whole.groupBy("head").agg(F.sum("n").alias("n_path"))
    return whole.join(sums, "head").select("edge", "head", "n_path")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_key, text_key, at, n): runs of n windows from word `at` on whose words also occur in a document with a smaller doc_id."""
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text"))
    schema = "minimiser long, doc_id long, text_key long, at long, n long, digest long, digest2 long"
    edges = stored(keyed.select(F.col("doc_key").alias("doc_id"), "text_key", "text").mapInArrow(_edges, schema), "edges")
    shared = stored(edges.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser"), "minimisers")
    small = shared.count() * 16 <= BROADCAST_BYTES
    found = stored(edges.join(F.broadcast(shared) if small else shared, "minimiser", "left_semi"), "shared")
    dropped(spark, edges)
    classes = found.groupBy("digest", "digest2").agg(F.first("minimiser").alias("minimiser"), F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
    classes = stored(classes, "classes")
    known = stored(found.join(classes.drop("minimiser"), ["digest", "digest2"]), "known")

    # whole paths that an earlier document has
    twice = known.where("source < last")
    walks = paths(twice.select("doc_id", "text_key", "at", "n", "digest", "digest2"))
    heads = walks.where("edge = head").select("edge.digest", "edge.digest2", "n_path")
    whole = twice.where("doc_id > source").join(heads, ["digest", "digest2"])
    whole = whole.select(F.col("doc_id").alias("doc_key"), "text_key", "at", F.col("n_path").alias("n"))

    # windows of source documents where different edges share a minimiser
    many = classes.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("minimiser")
    sources = known.where("doc_id = source").join(many, "minimiser", "left_semi")
    asked = _with_spans(docs.select("doc_id", "text"), sources.select(F.col("doc_id").alias("doc_key"), "text_key", "at", "n"), "inner")
    windows = asked.select(F.col("doc_key").alias("doc_id"), "text_key", "text", "spans").mapInArrow(_windows, "digest long, digest2 long, doc_id long, text_key long, at long")
    windows = stored(windows, "windows")
    least = windows.groupBy("digest", "digest2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last")
    single = windows.join(least, ["digest", "digest2"]).where("doc_id > source")
    single = single.select(F.col("doc_id").alias("doc_key"), "text_key", "at", F.lit(1).cast("long").alias("n")).distinct()
    return whole.union(single)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (words joined by one space); columns of these names are replaced.

    Each word covered by a 50-word window that also starts in a document with a smaller doc_id is removed. Words end at
    white space and are compared unchanged. Texts of fewer than 50 words are kept whole; a null text has no words and
    an empty kept_text. Repeated rows (same doc_id and text) are treated alike; a null doc_id counts as the largest.
    """
    spans = repeated_spans(docs)
    rest = docs.drop("n_words", "n_removed", "kept_text", "doc_key", "text_key", "spans")
    joined = _with_spans(rest, spans, "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text"]
    schema = ", ".join([*fields, "n_words long, n_removed long, kept_text string"])
    order = [f.name for f in rest.schema if f.name != "text"]
    made = joined.select(*order, "text", "spans").mapInArrow(_without, schema)
    return made
