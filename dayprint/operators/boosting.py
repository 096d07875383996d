"""Gradient-boosted trees of many models at once, by Spark ML's rules.

Spark's own boosting fits one model after the other and learns the bins anew for every tree; hundreds of small trees then wait
for the scheduler. Here the rows are binned once, and all models that share them (the classes of one-vs-rest, the folds of a
cross-validation, the algorithms of a training) grow their trees level by level together: one job for each level adds up the
counts and gradients of every open node by bin, the driver picks the best splits. Rows stay in their partitions as bytes, with
every model's prediction so far; the driver sees tables of (open nodes, bins), whatever the rows.

The rules are those of Spark's `GBTRegressor` and `GBTClassifier`: up to `maxBins` bins from the values' quantiles, splits by
variance, the first tree fitted on the labels with weight one, the others on the negative gradients with the step size, splits of
two-valued slots by category. Bins are learnt from all rows of a model's folds instead of a sample. The results are Spark ML models.
"""

from __future__ import annotations

import json
import pickle
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from dayprint.sources.workdir import new_folder, shared_root

#: Slots with few bins share a column of codes; a column has this many codes at most.
CODES = 64
#: Values of a slot that a partition's summary keeps at most.
KEPT_VALUES = 2048
#: Rows that are added up at once, so that keys and gradients stay in the processor's cache.
CHUNK = 32_768
#: Trees between two checkpoints of the predictions.
CHECKPOINT_TREES = 10

NODE_SCHEMA = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double,"
    " leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


@dataclass
class Member:
    """One sequence of trees: a regression, or a class against the others; rows of one fold may be left out."""

    estimator: object
    label_class: int | None = None
    left_out: int | None = None
    trees: list[Tree] = field(default_factory=list)

    @property
    def open(self) -> bool:
        return len(self.trees) < self.estimator.getMaxIter()

    @property
    def weight(self) -> float:
        return self.estimator.getStepSize() if self.trees else 1.0


@dataclass
class Tree:
    """Nodes in the order of their levels; a node's children follow it, a leaf has column -1."""

    column: list[int] = field(default_factory=list)  # of codes
    goes_left: list[int] = field(default_factory=list)  # bit c: rows with code c
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    split: list[tuple[int, float, int] | None] = field(default_factory=list)  # slot, threshold or category, categories
    depth: int = 0
    weight: float = 1.0
    squares: np.ndarray | None = None

    def add(self, rows: float, total: float) -> int:
        for values, v in ((self.column, -1), (self.goes_left, 0), (self.left, -1), (self.right, -1), (self.rows, rows), (self.total, total), (self.gain, -1.0), (self.split, None)):
            values.append(v)
        return len(self.column) - 1

    def prediction(self) -> np.ndarray:
        return np.array(self.total) / np.maximum(self.rows, 1)

    def walker(self) -> Walker:
        return Walker(np.array(self.column, np.int16), np.array(self.goes_left, np.uint64), np.array(self.left, np.int16), np.array(self.right, np.int16), self.depth)


@dataclass
class Walker:
    """What a task needs to send rows down a tree."""

    column: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: int

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row has reached; ``codes`` is (columns, rows)."""
        n = codes.shape[1]
        at = np.zeros(n, np.intp)
        if not self.depth:
            return at
        inner = self.column >= 0
        own = np.arange(len(self.column))
        way = (self.goes_left[:, None] >> np.arange(CODES, dtype=np.uint64)) & np.uint64(1) == 1
        after = np.where(inner[:, None], np.where(way, self.left[:, None], self.right[:, None]), own[:, None]).astype(np.intp).reshape(-1)
        start, flat, place = np.maximum(self.column, 0).astype(np.intp) * n, codes.reshape(-1), np.arange(n)
        for _ in range(self.depth):
            at = after[at * CODES + flat[start[at] + place]]
        return at


@dataclass
class Layout:
    """How slots are binned and where their bins lie among the columns of codes."""

    thresholds: list[np.ndarray]
    two_valued: set[int]
    columns: list[list[int]]

    @classmethod
    def of(cls, thresholds: list[np.ndarray], two_valued: set[int]) -> Layout:
        columns: list[list[int]] = []
        sizes: list[int] = []
        for slot in sorted((s for s, t in enumerate(thresholds) if len(t)), key=lambda s: -len(thresholds[s])):
            bins = len(thresholds[slot]) + 1
            for c, size in enumerate(sizes):
                if size * bins <= CODES:
                    columns[c].append(slot)
                    sizes[c] *= bins
                    break
            else:
                columns.append([slot])
                sizes.append(bins)
        return cls(thresholds, two_valued, columns or [[]])  # one code for all rows if nothing differs

    def bins(self, slot: int) -> int:
        return len(self.thresholds[slot]) + 1

    def size(self, column: int) -> int:
        return int(np.prod([self.bins(s) for s in self.columns[column]]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(columns, rows) of rows (rows, slots); a value up to the threshold lies in the bin before it."""
        out = np.zeros((len(self.columns), len(x)), np.uint8)
        for c, slots in enumerate(self.columns):
            for slot in slots:
                out[c] = out[c] * self.bins(slot) + np.searchsorted(self.thresholds[slot], x[:, slot], side="left").astype(np.uint8)
        return out

    def bin_of_code(self, column: int, slot: int) -> np.ndarray:
        sizes = [self.bins(s) for s in self.columns[column]]
        return np.unravel_index(np.arange(self.size(column)), sizes)[self.columns[column].index(slot)]


@dataclass
class Block:
    """A partition's rows, coded by each layout; ``squares`` are the last trees' sums of squared gradients by leaf."""

    codes: list[np.ndarray]
    label: np.ndarray
    fold: np.ndarray | None
    predicted: np.ndarray
    squares: list[np.ndarray]


@dataclass
class Part:
    """What a task has to know of a member at one level."""

    at: int
    layout: int
    label_class: int | None
    left_out: int | None
    first: bool

    def gradients(self, block: Block, rows: slice) -> np.ndarray:
        y, f = block.label[rows], block.predicted[self.at, rows]
        if self.label_class is not None:
            y = np.where(y == self.label_class, 1.0, -1.0)
        if self.first:
            return y
        return 2 * (y - f) if self.label_class is None else 4 * y / (1 + np.exp(2 * y * f))

    def counted(self, block: Block, rows: slice) -> np.ndarray | None:
        return None if self.left_out is None else block.fold[rows] != self.left_out


def _chunks(block: Block):
    for start in range(0, len(block.label), CHUNK):
        rows = slice(start, min(start + CHUNK, len(block.label)))
        yield rows, [np.ascontiguousarray(codes[:, rows]) for codes in block.codes]


def _add_up(block: Block, parts: list[Part], walkers: list[Walker], open_nodes: list[list[int]], sizes: list[list[int]]) -> list[np.ndarray]:
    """For each member (2, open nodes, codes): counts and sums of the gradients."""
    out = [np.zeros((2, len(nodes), sum(sizes[p.layout]))) for p, nodes in zip(parts, open_nodes)]
    with np.errstate(over="ignore"):
        for rows, coded in _chunks(block):
            for part, walker, nodes, sums in zip(parts, walkers, open_nodes, out):
                codes = coded[part.layout]
                place = np.full(len(walker.column), len(nodes))
                place[nodes] = np.arange(len(nodes))
                where = place[walker.leaves(codes)]
                counted = part.counted(block, rows)
                if counted is not None:
                    where = np.where(counted, where, len(nodes))
                g, where, upto = part.gradients(block, rows), where * CODES, (len(nodes) + 1) * CODES
                column = 0
                for c, size in enumerate(sizes[part.layout]):
                    key = where + codes[c]
                    for k, weights in enumerate((None, g)):
                        found = np.bincount(key, weights, upto).reshape(-1, CODES)[: len(nodes), :size]
                        sums[k, :, column : column + size] += found
                    column += size
    return out


def _advanced(block: Block, parts: list[Part], walkers: list[Walker], values: list[np.ndarray]) -> Block:
    """The block after the members' newest trees."""
    predicted, squares = block.predicted.copy(), [np.zeros(len(v)) for v in values]
    with np.errstate(over="ignore"):
        for rows, codes in _chunks(block):
            for k, (part, walker, value) in enumerate(zip(parts, walkers, values)):
                at, g = walker.leaves(codes[part.layout]), part.gradients(block, rows)
                predicted[part.at, rows] += value[at]
                counted = part.counted(block, rows)
                g = g * g if counted is None else np.where(counted, g * g, 0.0)
                squares[k] += np.bincount(at, g, len(value))
    return Block(block.codes, block.label, block.fold, predicted, squares)


def _summaries(rows: DataFrame, slots: int, folds: bool) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """For each fold each slot's values and how many rows have them; long lists are thinned to `KEPT_VALUES` ranks a partition."""

    def summed(batches):
        found: dict[int, list] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
            fold = batch.column("fold").to_numpy(zero_copy_only=False) if folds else np.zeros(len(x), int)
            for k in np.unique(fold).tolist():
                own = x[fold == k]
                of_slots = found.setdefault(k, [(np.zeros(0), np.zeros(0))] * slots)
                for s in range(slots):
                    of_slots[s] = _thinned(*_merged([of_slots[s], np.unique(own[~np.isnan(own[:, s]), s], return_counts=True)]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    parts = [pickle.loads(r["found"]) for r in rows.mapInArrow(summed, "found binary").collect()]
    return {k: [_merged([p[k][s] for p in parts if k in p]) for s in range(slots)] for k in sorted({k for p in parts for k in p})}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values))


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= 2 * KEPT_VALUES:
        return values, counts
    upto = np.cumsum(counts)
    part = np.minimum((upto - counts / 2) / upto[-1] * KEPT_VALUES, KEPT_VALUES - 1).astype(np.intp)
    # The middle value stands for its part.
    kept, first, n = np.unique(part, return_index=True, return_counts=True)
    return values[first + n // 2], np.bincount(part, counts, KEPT_VALUES)[kept]


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Between all values if they are few, else nearest to equal shares of the rows; as Spark's trees do."""
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return middle
    stride, upto, out = counts.sum() / bins, np.cumsum(counts), []
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _two_valued(encoded: DataFrame, features: str) -> set[int]:
    """Slots that the encoder marked as having two categories."""
    attrs = encoded.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    two = {a["idx"] for a in attrs.get("binary", [])}
    for a in attrs.get("nominal", []):
        if len(a.get("vals", [])) > 2:
            raise ValueError("Slots of more than two categories are not supported")
        two.add(a["idx"])
    return two


def _blocks(encoded: DataFrame, members: list[Member], features: str, label: str, fold: str | None) -> tuple[list[int | None], list[Layout], int, RDD]:
    """The rows in bytes, one block a partition; a layout for each fold that is left out."""
    kept = [vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")]
    rows = encoded.select(*kept, *([F.col(fold).cast("int").alias("fold")] if fold else []))
    n, slots = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("No rows to fit on")
    bins = {m.estimator.getMaxBins() for m in members}
    if len(bins) > 1 or max(bins) > CODES:
        raise ValueError(f"All members must have the same number of bins, {CODES} at most")
    two, most = _two_valued(encoded, features), bins.pop()
    found = _summaries(rows, slots, fold is not None)
    outs = list(dict.fromkeys(m.left_out for m in members))
    layouts = []
    for out in outs:
        mine = [of_slots for k, of_slots in found.items() if k != out or fold is None]
        if not mine:
            raise ValueError("No rows to fit on")
        seen = [_merged([of_slots[s] for of_slots in mine]) for s in range(slots)]
        least = min(most, int(max((counts.sum() for _, counts in seen), default=0))) or 1
        # A category's value is 0 or 1; the bins of both are there even if one is not met.
        layouts.append(Layout.of([np.array([0.5]) if s in two else thresholds(*seen[s], least) for s in range(slots)], two))

    models = len(members)

    def packed(batches):
        codes, labels, folds = [[np.zeros((len(x.columns), 0), np.uint8)] for x in layouts], [np.zeros(0)], [np.zeros(0, np.int16)]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
            for layout, mine in zip(layouts, codes):
                mine.append(layout.codes(x))
            labels.append(batch.column("y").to_numpy(zero_copy_only=False).astype(float))
            if fold:
                folds.append(batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int16))
        y = np.concatenate(labels)
        block = Block([np.concatenate(c, 1) for c in codes], y, np.concatenate(folds) if fold else None, np.zeros((models, len(y))), [])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return outs, layouts, slots, rows.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _best_splits(layout: Layout, sums: np.ndarray, least: np.ndarray) -> list[tuple]:
    """For each open node (gain, slot, bins left of the split, rows left, total left), the first of equal gains."""
    counts, totals = sums
    nodes = len(counts)
    n, s = (t[:, : layout.size(0)].sum(1) for t in sums)
    best = [np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes), np.zeros(nodes)]
    starts = np.cumsum([0, *map(layout.size, range(len(layout.columns)))])
    column_of = {slot: c for c, slots in enumerate(layout.columns) for slot in slots}
    for slot in sorted(column_of):
        c = column_of[slot]
        sizes = [layout.bins(x) for x in layout.columns[c]]
        others = tuple(i + 1 for i, x in enumerate(layout.columns[c]) if x != slot)
        mine = [t[:, starts[c] : starts[c + 1]].reshape(nodes, *sizes).sum(others) if others else t[:, starts[c] : starts[c + 1]] for t in (counts, totals)]
        left, left_sum = (np.cumsum(t, 1)[:, :-1] for t in mine)
        right, right_sum = n[:, None] - left, s[:, None] - left_sum
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left_sum**2 / left + right_sum**2 / right - (s**2 / n)[:, None]) / n[:, None]
        gain = np.where((left >= least[:, None]) & (right >= least[:, None]), gain, -1.0)
        at = gain.argmax(1)
        every = np.arange(nodes)
        better = gain[every, at] > best[0]
        for kept, new in zip(best, (gain[every, at], np.full(nodes, slot), at + 1, left[every, at], left_sum[every, at])):
            kept[better] = new[better]
    return list(zip(*(b.tolist() for b in best)))


def _grow(layout: Layout, tree: Tree, node: int, found: tuple) -> list[int]:
    """The node's children, or none if no split gains anything."""
    gain, slot, left_bins, rows, total = found
    # A node whose rows are alike has sums that differ by rounding only.
    if slot < 0 or gain <= 1e-14 * max(1e-300, (tree.total[node] / tree.rows[node]) ** 2):
        return []
    c = next(c for c, slots in enumerate(layout.columns) if slot in slots)
    left_codes = layout.bin_of_code(c, slot) < left_bins
    other = (tree.rows[node] - rows, tree.total[node] - total)
    sides, split = [(rows, total), other], (slot, float(layout.thresholds[slot][left_bins - 1]), -1)
    if slot in layout.two_valued:
        # The category with the smaller mean goes left.
        swap = total / rows > other[1] / other[0]
        sides, left_codes, split = (sides[::-1], ~left_codes, (slot, 1.0, 2)) if swap else (sides, left_codes, (slot, 0.0, 2))
    tree.column[node], tree.gain[node], tree.split[node] = c, gain, split
    tree.goes_left[node] = sum(1 << int(code) for code in np.flatnonzero(left_codes))
    tree.left[node], tree.right[node] = tree.add(*sides[0]), tree.add(*sides[1])
    return [tree.left[node], tree.right[node]]


def grow_members(encoded: DataFrame, members: list[Member], features: str = "features", label: str = "label", fold: str | None = None) -> int:
    """Fill the members' trees; the number of slots. ``encoded`` is read twice and should be kept by the caller."""
    spark = encoded.sparkSession
    if any(m.label_class is None for m in members) and encoded.where(F.col(label).isNull() | F.isnan(label)).limit(1).count():
        raise ValueError("Labels MUST NOT be Null or NaN")
    outs, layouts, slots, state = _blocks(encoded, members, features, label, fold)
    sizes = [[x.size(c) for c in range(len(x.columns))] for x in layouts]
    state, former, written, made = state.persist(StorageLevel.MEMORY_AND_DISK), None, None, 0
    try:
        while any(m.open for m in members):
            active = [(i, m) for i, m in enumerate(members) if m.open]
            parts = [Part(i, outs.index(m.left_out), m.label_class, m.left_out, not m.trees) for i, m in active]
            trees = [Tree(weight=m.weight) for _, m in active]
            least = [m.estimator.getMinInstancesPerNode() for _, m in active]
            open_nodes: list[list[int]] = [[0]] * len(active)
            for t in trees:
                t.add(0.0, 0.0)
            level = 0
            while any(open_nodes):
                some = [k for k, nodes in enumerate(open_nodes) if nodes]
                task = ([parts[k] for k in some], [trees[k].walker() for k in some], [open_nodes[k] for k in some], sizes)
                sums = None
                for add, squares in state.map(_Sums(task, level == 0)).collect():
                    sums = add if sums is None else [a + b for a, b in zip(sums, add)]
                    if squares:
                        _add_squares(members, squares, made)
                if former is not None:
                    former.unpersist()
                    former = None
                if level == 0:
                    for k, t in enumerate(trees):
                        t.rows[0], t.total[0] = (float(sums[k][i, 0, : sizes[parts[k].layout][0]].sum()) for i in (0, 1))
                        if not t.rows[0]:
                            raise ValueError("No rows to fit on")
                level += 1
                following: list[list[int]] = [[] for _ in active]
                for g, layout in enumerate(layouts):
                    mine = [(k, add) for k, add in zip(some, sums) if parts[k].layout == g]
                    if not mine:
                        continue
                    fewest = np.repeat([least[k] for k, _ in mine], [len(open_nodes[k]) for k, _ in mine])
                    found = iter(_best_splits(layout, np.concatenate([add for _, add in mine], 1), fewest))
                    for k, _ in mine:
                        for node in open_nodes[k]:
                            children = _grow(layout, trees[k], node, next(found))
                            if children:
                                trees[k].depth = level
                                if level < active[k][1].estimator.getMaxDepth():
                                    following[k] += children
                open_nodes = following
            values = [t.weight * t.prediction() for t in trees]
            for (_, m), t in zip(active, trees):
                m.trees.append(t)
            made += 1
            former = state
            state = former.map(_Advance(parts, [t.walker() for t in trees], values)).persist(StorageLevel.MEMORY_AND_DISK)
            if made % CHECKPOINT_TREES == 0:
                written = _cut_lineage(spark, state, former, written)
                former = None
        # The last trees' squares.
        for squares in state.map(_squares).collect():
            _add_squares(members, squares, made)
    finally:
        for kept in (state, former):
            if kept is not None:
                kept.unpersist()
        _delete(spark, written)
    return slots


class _Sums:
    def __init__(self, task, with_squares):
        self.task, self.with_squares = task, with_squares

    def __call__(self, block: Block):
        return _add_up(block, *self.task), block.squares if self.with_squares else []


class _Advance:
    def __init__(self, parts, walkers, values):
        self.task = (parts, walkers, values)

    def __call__(self, block: Block) -> Block:
        return _advanced(block, *self.task)


def _squares(block: Block) -> list[np.ndarray]:
    return block.squares


def _add_squares(members: list[Member], squares: list[np.ndarray], made: int) -> None:
    """Sums of squared gradients by leaf, of the members that grew the newest trees."""
    newest = [m.trees[-1] for m in members if len(m.trees) == made]
    for tree, found in zip(newest, squares, strict=True):
        tree.squares = found if tree.squares is None else tree.squares + found


def _cut_lineage(spark: SparkSession, state: RDD, former: RDD, written: str | None) -> str:
    """Write the predictions, so that the plan does not grow with the trees; delete the former copy."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    state.checkpoint()
    state.count()
    former.unpersist()
    _delete(spark, written)
    return state.getCheckpointFile()


def _delete(spark: SparkSession, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _node_rows(tree: Tree, number: int) -> list[tuple]:
    squares = tree.squares.copy()
    for node in reversed(range(len(squares))):  # children follow their parent
        if tree.column[node] >= 0:
            squares[node] = squares[tree.left[node]] + squares[tree.right[node]]
    out = []
    for node, (rows, total, q) in enumerate(zip(tree.rows, tree.total, squares.tolist())):
        mean = total / max(rows, 1)
        slot, at, categories = tree.split[node] or (-1, None, -1)
        split = (slot, [] if at is None else [at], categories)
        out.append((number, (node, mean, max(q / max(rows, 1) - mean * mean, 0.0), [rows, total, q], int(rows), tree.gain[node], tree.left[node], tree.right[node], split)))
    return out


def _settings(spark: SparkSession, estimator, kind: str, extra: dict) -> str:
    """The metadata that Spark's reader expects of a model of this estimator."""
    path = new_folder(spark, "settings")
    estimator.save(path)
    found = json.loads(spark.sparkContext.textFile(f"{path}/metadata").first())
    return json.dumps({**found, "class": kind, **extra})


def _model(spark: SparkSession, member: Member, slots: int):
    """The Spark ML model of a member's trees, through Spark's own saved form."""
    estimator = member.estimator
    family, reader = ("regression.GBTRegressionModel", GBTRegressionModel) if member.label_class is None else ("classification.GBTClassificationModel", GBTClassificationModel)
    path = new_folder(spark, "boosted")
    about = _settings(spark, estimator, f"org.apache.spark.ml.{family}", {"numFeatures": slots, "numTrees": len(member.trees)})
    one = DecisionTreeRegressor(maxDepth=estimator.getMaxDepth(), seed=estimator.getSeed())
    of_tree = json.loads(_settings(spark, one, "org.apache.spark.ml.regression.DecisionTreeRegressionModel", {}))
    named = [(i, json.dumps({**of_tree, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), t.weight) for i, t in enumerate(member.trees)]
    nodes = [row for i, t in enumerate(member.trees) for row in _node_rows(t, i)]
    spark.sparkContext.parallelize([about], 1).saveAsTextFile(f"{path}/metadata")
    spark.createDataFrame(named, "_1 int, _2 string, _3 double", verifySchema=False).coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODE_SCHEMA, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
    return reader.load(path)


def boosted(estimator) -> bool:
    """Whether `fit_boosted` takes this estimator."""
    one = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    return isinstance(one, GBTRegressor | GBTClassifier) and isinstance(estimator, OneVsRest | GBTRegressor)


def fit_boosted(encoded: DataFrame, estimators: list, left_out: list[int | None] | None = None, fold: str = "fold") -> list:
    """The Spark ML models of all ``estimators`` (boosted regressions, one-vs-rest of boosted classes), grown together.

    A model of ``left_out`` i learns from the rows whose ``fold`` is not i. The estimators share their features and label; the
    rows are read twice, so ``encoded`` should be kept.
    """
    spark = encoded.sparkSession
    left_out = left_out or [None] * len(estimators)
    groups: list[list[Member]] = []
    features, label = estimators[0].getFeaturesCol(), estimators[0].getLabelCol()
    classes = None
    for e, out in zip(estimators, left_out, strict=True):
        if not isinstance(e, OneVsRest):
            groups.append([Member(e, None, out)])
            continue
        if classes is None:
            last = encoded.agg(F.max(label)).first()[0]
            if last is None:
                raise ValueError("No rows to fit on")
            classes = int(last) + 1
        one = e.getClassifier().copy({e.getClassifier().featuresCol: features})
        groups.append([Member(one, c, out) for c in range(classes)])
    members = [m for g in groups for m in g]
    slots = grow_members(encoded, members, features, label, fold if any(o is not None for o in left_out) else None)
    with ThreadPoolExecutor(4) as pool:
        models = iter(list(pool.map(lambda m: _model(spark, m, slots), members)))
    made = [[next(models) for _ in g] for g in groups]
    return [e._copyValues(OneVsRestModel(models=found)) if isinstance(e, OneVsRest) else found[0] for e, found in zip(estimators, made)]
