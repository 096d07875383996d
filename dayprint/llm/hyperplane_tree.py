"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

Rows are integer vectors x, lengthened by one number so that all have the same norm M; an anchor is lengthened by 0. Then
distance^2 = |anchor|^2 + M^2 - 2 * score: a window of scores is an annulus of distances about the anchor. Each node of the tree
has split points; a row belongs to the nearest one. Split points are chosen from a bounded sample, but every row is placed, and
the range of distances from each split point to each sibling's rows is taken over all rows. A subtree is left out when, for some
split point, its range misses what the annulus allows; rows of the leaves that remain are scored exactly in integers.

Anchors are broadcast in blocks of bounded size and all rows are read once for each pass: a probe of the nearest leaves
gives each anchor a score that its k-th result reaches at least, then the annuli of these bounds are searched whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayprint.llm.store import dropped, stored

#: Rows that split points are chosen from.
FIT_ROWS = 20_000
#: Split points of a node; a node with at most so many rows (by the sample's share) is a leaf; levels of nodes.
FAN, LEAF_ROWS, LEVELS = 16, 512, 3
#: Children of each node that a probe enters.
PROBED = 2
#: Anchors that are broadcast at once; anchors and rows in one block of scores.
ANCHORS, SIDE = 20_000, 2048


class Tree:
    """points[n]: split points of node n, lengthened; child[n][j]: node below, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, norm2: int, rows: int, seed: int = 7):
        self.norm2 = float(norm2)
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.paths: list[list[tuple[int, int]]] = []
        draw = np.random.default_rng(seed)
        self._grow(self.lengthened(sample.astype(np.float64)), max(1.0, rows / max(1, len(sample))), [], draw)
        # ranges[n][i, j]: distances from split point i to the rows of child j
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]

    def _grow(self, x: np.ndarray, weight: float, path: list[tuple[int, int]], draw) -> int:
        distinct = np.unique(x, axis=0) if len(x) * weight > LEAF_ROWS and len(path) < LEVELS else x[:1]
        if len(distinct) < 2:
            self.paths.append(path)
            return -len(self.paths)
        # far apart: greedily from three times as many candidates
        some = distinct[draw.choice(len(distinct), min(3 * FAN, len(distinct)), replace=False)]
        chosen = [0]
        gap = self.distances(some, some[:1])[:, 0]
        while len(chosen) < min(FAN, len(some)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, self.distances(some, some[chosen[-1:]])[:, 0])
        node = len(self.points)
        self.points.append(some[chosen])
        self.child.append([])
        near = self.distances(x, self.points[node]).argmin(1)
        for j in range(len(chosen)):
            self.child[node].append(self._grow(x[near == j], weight, [*path, (node, j)], draw))
        return node

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None]], 1)

    @staticmethod
    def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0))

    def placed(self, x: np.ndarray, seen: dict) -> np.ndarray:
        """The leaf of each row; `seen` gathers (node, i, j): [least, greatest distance]."""
        leaf = np.zeros(len(x), np.int64)
        if not self.points:
            return leaf
        x = self.lengthened(x)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            d = self.distances(x[rows], self.points[node])
            near = d.argmin(1)
            for j in np.unique(near):
                mine = near == j
                for i, (a, b) in enumerate(zip(d[mine].min(0), d[mine].max(0))):
                    old = seen.setdefault((node, i, int(j)), [a, b])
                    old[0], old[1] = min(old[0], a), max(old[1], b)
                below = self.child[node][j]
                if below < 0:
                    leaf[rows[mine]] = -1 - below
                else:
                    todo.append((below, rows[mine]))
        return leaf

    def asked(self, q: np.ndarray) -> list[np.ndarray]:
        """Distances of the anchors from the split points of each node."""
        q = np.concatenate([q, np.zeros((len(q), 1))], 1)
        return [self.distances(q, p) for p in self.points]

    def near(self, leaf: int, dist: list[np.ndarray]) -> np.ndarray:
        """Which anchors probe the leaf."""
        ok = None
        for node, j in self.paths[leaf]:
            d = dist[node]
            mine = (d < d[:, j : j + 1]).sum(1) < PROBED
            ok = mine if ok is None else ok & mine
        return ok

    def meets(self, leaf: int, dist: list[np.ndarray], inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Which anchors may have a row of the leaf between `inner` and `outer`."""
        ok = np.ones(len(inner), bool)
        for node, j in self.paths[leaf]:
            d = dist[node]
            least = np.maximum(np.maximum(d - outer[:, None], inner[:, None] - d), 0)
            ok &= ((self.high[node][:, j] >= least) & (self.low[node][:, j] <= d + outer[:, None])).all(1)
        return ok


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _placed(shared, width: int):
    def run(batches):
        for batch in batches:
            values = batch.column("x").combine_chunks() if isinstance(batch.column("x"), pa.ChunkedArray) else batch.column("x")
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            leaf = shared.value.placed(x.astype(np.float64), {})
            raw = pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), raw, pa.array(leaf)], ["vec_id", "label", "x", "leaf"])

    return run


def _ranges(shared, width: int):
    def run(batches):
        seen: dict = {}
        for batch in batches:
            shared.value.placed(_rows(batch.column("x"), width).astype(np.float64), seen)
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["node", "i", "j", "low", "high"]).astype({"node": "int64", "i": "int64", "j": "int64", "low": "float64", "high": "float64"}))

    return run


class Asked:
    """A block of anchors, each with windows of scores."""

    def __init__(self, frame: pd.DataFrame, width: int, exact_floats: bool):
        self.ids, self.labels = frame["vec_id"].to_numpy(), frame["label"].to_numpy()
        self.x = np.frombuffer(b"".join(frame["x"]), "<i8").reshape(-1, width)
        self.kind = np.float64 if exact_floats else np.int64
        self.norm2 = (self.x.astype(np.float64) ** 2).sum(1)

    def windows(self, low: np.ndarray, high: np.ndarray) -> Asked:
        """low, high: least and greatest score of each anchor's windows; low > high where there is none."""
        self.low, self.high = low, high
        return self


def _first(at: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n best of each `at`: highest scores first, then smaller ids."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return order[rank < n]


def _scores(shared, width: int, same: bool, n: int, probe: bool):
    """The n best of each anchor's windows among a task's rows of the same, or of other labels."""

    def run(batches):
        tree, asked = shared.value
        dist = tree.asked(asked.x.astype(np.float64))
        windows = asked.low.shape[1]
        some = asked.low <= asked.high
        least = np.where(some, asked.low, np.inf).min(1)
        most = np.where(some, asked.high, -np.inf).max(1)
        # distances of the windows' ends; half an integer and a little more keeps rounding from losing rows
        reach = lambda s: np.sqrt(np.maximum(asked.norm2 + tree.norm2 - 2 * s, 0))
        little = 1e-6 * (1 + math.sqrt(tree.norm2))
        outer, inner = reach(least) + little, np.maximum(reach(most) - little, 0)
        inner, outer = np.where(some.any(1), inner, 1.0), np.where(some.any(1), outer, -1.0)
        held = [np.zeros(0, np.int64) for _ in range(3)]
        floor = asked.low.astype(np.float64)  # rises with what the task has found
        q = asked.x.astype(asked.kind)
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            x, ids, labels = _rows(batch.column("x"), width).astype(asked.kind), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for one in np.unique(leaf):
                rows = np.flatnonzero(leaf == one)
                every = np.ones(len(q), bool) if not tree.paths[one] else None
                wanted = every if every is not None else tree.near(one, dist) if probe else tree.meets(one, dist, inner, outer)
                wanted = np.flatnonzero(wanted & some.any(1))
                for a in range(0, len(wanted), SIDE):
                    mine = wanted[a : a + SIDE]
                    for b in range(0, len(rows), SIDE):
                        part = rows[b : b + SIDE]
                        score = q[mine] @ x[part].T
                        fit = (asked.labels[mine][:, None] == labels[part]) == same
                        fit &= asked.ids[mine][:, None] != ids[part]
                        found = [[], [], []]
                        for k in range(windows):
                            r, c = np.nonzero(fit & (score >= floor[mine, k, None]) & (score <= asked.high[mine, k, None]))
                            found[0].append(mine[r] * windows + k)
                            found[1].append(score[r, c].astype(np.int64))
                            found[2].append(ids[part][c])
                        held = [np.concatenate([h, *f]) for h, f in zip(held, found)]
                        keep = _first(*held, n)
                        held = [h[keep] for h in held]
                        at, full = np.unique(held[0], return_counts=True)
                        last = held[1][np.cumsum(full) - 1]
                        enough = full == n
                        flat = floor.reshape(-1)
                        flat[at[enough]] = np.maximum(flat[at[enough]], last[enough])
        at, score, ids = held
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (asked.ids[at // windows], at % windows, ids, score)], ["anchor_id", "k", "other_id", "score"])

    return run


FOUND = "anchor_id long, k long, other_id long, score long"


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "k").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _bounds(asked: Asked, low: np.ndarray, probed: DataFrame, n: int) -> np.ndarray:
    """The windows' lower ends raised to the score that n probed rows reach."""
    got = probed.where(F.col("rank") == n).select("anchor_id", "k", "score").toPandas()
    low = low.copy()
    if len(got):
        at = np.searchsorted(asked.ids, got["anchor_id"].to_numpy())
        k = got["k"].to_numpy()
        low[at, k] = np.maximum(low[at, k], got["score"].to_numpy())
    return low


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, x): floor(scale * component) of the rows that take part."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & (F.size("embedding") > 0))
    x = F.transform("embedding", lambda v: F.floor(scale * v.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def hard_negatives(vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, embedding, label).

    `anchors` says by vec_id which rows are anchors. Rows with a null vec_id, label or vector, an empty vector, or a null or
    non-finite component take no part, nor do vectors of another length than most. Of several rows with one vec_id the one
    with the least (label, vector) counts. Ties go to the smaller vec_id. Negative scores have no window but their own
    (low * score > high * score), so such positives return nothing. Further columns are ignored; an empty table gives an empty
    result. Results are exact. Scores that may exceed 64 bits raise an error.
    """
    spark = vectors.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    largest = vectors.select(F.max(F.array_max(F.transform("embedding", lambda v: F.when(F.abs(v) < float("inf"), F.abs(v.cast("double")))))).alias("m")).first()["m"] or 0.0
    length = F.size("embedding")
    widths = vectors.where("embedding is not null").groupBy(length.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    width = widths["d"] if widths else 0
    if not width:
        return spark.createDataFrame([], empty)
    bound = width * (scale * largest + 1) ** 2
    if 100 * bound >= 2**63:
        raise ValueError("components too large for 64-bit scores")
    rows = integers(vectors.where(length == width), scale)
    rows = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x"), "rows")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    total, norm2 = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not total:
        return spark.createDataFrame([], empty)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)) < int(min(1.0, 0.9 * FIT_ROWS / total) * 1_000_000) + 1).select("x").limit(FIT_ROWS).collect()
    tree = Tree(np.array([r["x"] for r in sample], np.int64).reshape(-1, width), norm2, total)
    index = rows.mapInArrow(_placed(spark.sparkContext.broadcast(tree), width), "vec_id long, label long, x binary, leaf long")
    # neighbours in the tree lie together; a crowded leaf is dealt over several partitions by the second key
    parts = max(1, min(4096, int(total) // 8192 + 1))
    index = stored(index.repartitionByRange(parts, "leaf", F.xxhash64("vec_id")).sortWithinPartitions("leaf"), "placed")
    if tree.points:
        ranges = index.select("x").mapInArrow(_ranges(spark.sparkContext.broadcast(tree), width), "node long, i long, j long, low double, high double")
        # as many rows as the tree has pairs of split points: 273 nodes of 16 at most
        for r in ranges.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]

    mine = index.where(anchors).select("vec_id", "label", "x")
    blocks = -(-mine.count() // ANCHORS) * 2 if mine.count() > ANCHORS else 1
    out = spark.createDataFrame([], empty)
    for block in range(blocks):
        part = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toPandas()
        if not len(part):
            continue
        asked = Asked(part, width, bound < 2**52)

        def search(low: np.ndarray, high: np.ndarray, same: bool, n: int, probe: bool) -> DataFrame:
            shared = spark.sparkContext.broadcast((tree, asked.windows(low, high)))
            return stored(_best(index.mapInArrow(_scores(shared, width, same, n, probe), FOUND), n), "found")

        def exact(low: np.ndarray, high: np.ndarray, same: bool, n: int) -> DataFrame:
            probed = search(low, high, same, n, True)
            low = _bounds(asked, low, probed, n)
            dropped(spark, probed)
            return search(low, high, same, n, False)

        lowest, highest = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4
        met = exact(np.full((len(part), 1), lowest), np.full((len(part), 1), highest), True, positives)
        windows = np.full((len(part), positives), highest), np.full((len(part), positives), lowest)
        got = met.select("anchor_id", "rank", "score").toPandas()
        at, k, score = np.searchsorted(asked.ids, got["anchor_id"].to_numpy()), got["rank"].to_numpy() - 1, got["score"].to_numpy()
        windows[0][at, k], windows[1][at, k] = -(-low * score // high), score
        mined = exact(*windows, False, negatives)
        positive = met.select("anchor_id", (F.col("rank") - 1).cast("long").alias("k"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = positive.join(mined.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"}), ["anchor_id", "k"])
        out = out.union(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return out
