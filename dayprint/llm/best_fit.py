"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Only the number of pieces of each length decides a best-fit decreasing layout, so the layout is computed from the
histogram of lengths (as many rows as the capacity at most) and then looked up by every piece. A segment tree over the
remaining capacities finds the tightest open sequences in logarithmic time; equal pieces that go into equal sequences
are placed together, which is what placing them one by one would give.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayprint.llm.store import sized, stored
from dayprint.llm.words import chunks, tokenizer, with_end


class CapacityTree:
    """Which remaining capacities have open sequences; the smallest one of at least n in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.leaves
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, n: int) -> int | None:
        at = n + self.leaves
        if self.open[at]:
            return n
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def layout(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces per sequence), by length and first rank.

    A row places the pieces of one length from a rank on: `per` of them side by side in each of consecutive sequences.
    Every run of sequences is cut at most once for each length, and what remains of a run shrinks to less than half
    each time it is filled, so there are at most about 4 * capacity * log2(capacity) rows, whatever the input's size.
    """
    tree, runs = CapacityTree(capacity), defaultdict(list)
    rows, opened = [], 0

    def leave(first: int, n: int, remaining: int) -> None:
        if n and remaining:
            runs[remaining].append((first, n))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, opened, max(1, -(-left // (capacity // length)))
                opened += n
            else:
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.mark(remaining, False)
            per = remaining // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, first, capacity - remaining, per))
                rank, left = rank + full * per, left - full * per
                leave(first, full, remaining - per * length)
            first, n = first + full, n - full
            if n and left:  # the last sequence takes fewer
                rows.append((length, rank, first, capacity - remaining, left))
                leave(first, 1, remaining - left * length)
                first, n, left = first + 1, n - 1, 0
            leave(first, n, remaining)
    return np.array(rows, np.int64).reshape(-1, 5)


def _pieces(path: str, end: int, capacity: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in chunks(batch, "text"):
                ids, n = with_end(*tokenizer(path).encode(piece.column("text")), end)
                per_doc = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), per_doc)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = number * capacity
                length = np.minimum(n[doc] - start, capacity)
                # the rank of each piece among those of its length in this task
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
                seen += np.bincount(length, minlength=capacity + 1)
                edges = pa.array(np.concatenate([[0], np.cumsum(length) * 4]), pa.int64())
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, edges.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc), part), pa.int32()),
                        piece.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                        pa.array(number, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, rank)),
                        raw.cast(pa.binary()),
                    ],
                    ["part", "doc_id", "piece", "start", "length", "local_rank", "ids"],
                )

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most `capacity` ids of the documents' texts with `end_id` at the end; only longer ones are cut."""
    schema = "part int, doc_id long, piece int, start long, length long, local_rank long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, end_id, capacity), schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every piece of (doc_id, text).

    A null or empty text is a piece with the end id alone; repeated rows are packed as often as they occur; further
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # As many rows as there are lengths, and the layout's proven bound.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(layout(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = sized(stored(bases, "ranks"), 32)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, n, r = plan.value, length.to_numpy(), rank.to_numpy()
        out = np.empty((len(n), 2), np.int64)
        firsts = np.searchsorted(rows[:, 0] * -1, -np.unique(n), "left")  # lengths descend
        for size, first in zip(np.unique(n), firsts):
            mine = n == size
            own = rows[first : np.searchsorted(rows[:, 0] * -1, -size, "right")]
            row = own[np.searchsorted(own[:, 1], r[mine], "right") - 1]
            ahead = r[mine] - row[:, 1]
            out[mine, 0] = row[:, 2] + ahead // row[:, 4]
            out[mine, 1] = row[:, 3] + ahead % row[:, 4] * size
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    spot = place("length", (F.col("base") + F.col("local_rank")).alias("rank"))
    placed = pieces.join(bases, ["part", "length"]).withColumn("spot", spot)
    return placed.select("doc_id", "piece", "start", "length", "ids", "spot.sequence_id", "spot.offset")
