"""Node tables of fitted models, and path-dependent Shapley values of tree ensembles.

A fitted forest or boosted ensemble is written by Spark ML's own writer, and its nodes are read back as a table: split,
children, rows that reached the node while fitting. The table's size is checked before it is collected and broadcast; records
are then explained where they lie, in Arrow batches.

Method. When a set of features is known, an unknown split sends a record both ways in proportion to the rows seen while
fitting. A leaf then plays a product game: each feature on its path brings a factor 1 or 0 if known, and its share z of rows if
not. The Shapley value of a factor in a product is an integral of the other factors over t in [0, 1], each mixed as
z * (1 - t) + known * t; Gauss-Legendre nodes solve it exactly, because it is a polynomial of known degree. One walk over a
tree carries the products at the nodes t down and the sums over leaves back up, for all records of a batch at once.

A record's values depend only on which way it goes at each node. For ensembles of shallow trees the values of each lowest part
of a tree (two levels of splits) are therefore computed once for every combination of the path's features and the part's
splits, and a record adds up one row of a table for each part. Trees whose tables would be too large are walked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayprint.sources.workdir import new_folder

#: Nodes of an ensemble that are collected and broadcast at most, about 100 bytes each.
MOST_NODES = 1_000_000
#: Records that one walk takes along.
ROWS_AT_ONCE = 4096
#: Levels of splits in the lowest parts of a tree.
PART_LEVELS = 2
#: Numbers in the tables of all parts at most (8 bytes each, sent to every executor).
MOST_TABLE = 8_000_000


@dataclass
class TreeEnsemble:
    """Nodes of all trees one after the other; a leaf has feature -1 and a value for each output."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    depth: int
    intercept: np.ndarray
    # The lowest parts by their top node, if `tabulate` found room for them: its table.
    parts: dict[int, np.ndarray] | None = None

    @property
    def outputs(self) -> int:
        return self.value.shape[1]

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature[node]] <= self.threshold[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, outputs)."""
        out = np.tile(self.intercept, (len(x), 1))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(left, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def expected(self) -> np.ndarray:
        """The mean output over the rows of the fit, by the nodes' covers."""
        total = self.intercept.copy()
        for root in self.roots:
            todo = [(root, 1.0)]
            while todo:
                node, share = todo.pop()
                if self.feature[node] < 0:
                    total += share * self.value[node]
                else:
                    for child in (self.left[node], self.right[node]):
                        todo.append((child, share * self._share(child, node)))
        return total

    def _share(self, child: int, node: int) -> float:
        return max(self.cover[child] / max(self.cover[node], 1e-300), 1e-12)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, outputs); a record's values add up to its output minus `expected`."""
        out = np.zeros((len(x), x.shape[1], self.outputs))
        degree = min(self.depth, x.shape[1])
        nodes, weights = np.polynomial.legendre.leggauss(max(1, math.ceil(degree / 2)))
        t, w = (nodes + 1) / 2, weights / 2
        for at in range(0, len(x), ROWS_AT_ONCE):
            if self.parts is not None:
                self._look_up(x[at : at + ROWS_AT_ONCE], out[at : at + ROWS_AT_ONCE])
                continue
            for root in self.roots:
                self._walk(root, x[at : at + ROWS_AT_ONCE], np.ones((min(len(x) - at, ROWS_AT_ONCE), len(t))), {}, t, w, out[at : at + ROWS_AT_ONCE])
        return out

    def _walk(self, node, x, product, used, t, w, out) -> np.ndarray:
        """The sum over the leaves below of value * product, (rows, nodes t, outputs)."""
        if self.feature[node] < 0:
            return product[:, :, None] * self.value[node]
        f = int(self.feature[node])
        left = self.goes_left(node, x)
        total = 0.0
        for child, here in ((self.left[node], left), (self.right[node], ~left)):
            z, known = self._share(child, node), here
            below, gain = product, 0.0
            if f in used:
                # the feature was met above: its factor is replaced, and what it was given for these leaves taken back
                known_above, z_above, factor_above, gain_above = used[f]
                z, known = z * z_above, here & known_above
                below = product / factor_above
                gain = -gain_above
            at = known.astype(np.intp)
            factor = np.stack([z * (1 - t), z * (1 - t) + t])[at]
            # what the factor changes when it becomes known, by its mixed value, times the weights of t
            mine = np.stack([-w / (1 - t), w * (1 - z) / (z * (1 - t) + t)])[at]
            sums = self._walk(child, x, below * factor, {**used, f: (known, z, factor, mine)}, t, w, out)
            gain = gain + mine
            if sums.shape[2] == 1:
                out[:, f, 0] += (gain * sums[:, :, 0]).sum(1)
            else:
                out[:, f, :] += np.einsum("rq,rqk->rk", gain, sums)
            total = total + sums
        return total


    def tabulate(self, features: int) -> TreeEnsemble:
        """Fill `parts` for records of ``features`` slots, unless their tables are larger than `MOST_TABLE`."""
        tops, size = [], 0
        for root in self.roots:
            todo = [(root, {})]
            while todo:
                node, path = todo.pop()
                inside = self._splits(node)
                if inside is not None:
                    tops.append((node, path, inside))
                    size += (features * self.outputs) << (len(path) + len(inside))
                    if size > MOST_TABLE:
                        return self
                    continue
                f = int(self.feature[node])
                for child in (self.left[node], self.right[node]):
                    todo.append((child, {**path, f: path.get(f, 1.0) * self._share(child, node)}))
        self.parts = {int(node): self._table(node, path, inside, features) for node, path, inside in tops}
        return self

    def _splits(self, top) -> list[int] | None:
        """The splits below and at a node; None if they fill more than `PART_LEVELS` levels."""
        level, found = [top], []
        for _ in range(PART_LEVELS):
            level = [n for n in level if self.feature[n] >= 0]
            found += level
            level = [child for n in level for child in (self.left[n], self.right[n])]
        return found if all(self.feature[n] < 0 for n in level) else None

    def _table(self, top, path: dict, inside: list[int], features: int) -> np.ndarray:
        """(combinations, features * outputs): bit i is the path's i-th feature being known to lead here, then each split going left."""
        bits = (np.arange(1 << (len(path) + len(inside)))[:, None] >> np.arange(len(path) + len(inside))) & 1 == 1
        left = {node: bits[:, len(path) + i] for i, node in enumerate(inside)}
        out = np.zeros((len(bits), features, self.outputs))
        todo = [(top, {f: (z, bits[:, i]) for i, (f, z) in enumerate(path.items())})]
        while todo:
            node, known = todo.pop()
            if self.feature[node] < 0:
                self._add_leaf(self.value[node], known, out)
                continue
            f = int(self.feature[node])
            z, above = known.get(f, (1.0, True))
            for child, here in ((self.left[node], left[node]), (self.right[node], ~left[node])):
                todo.append((child, {**known, f: (z * self._share(child, node), here & above)}))
        return out.reshape(len(bits), -1)

    @staticmethod
    def _add_leaf(value, known: dict, out) -> None:
        """The Shapley values of one leaf's product game."""
        if not known:
            return
        t, w = np.polynomial.legendre.leggauss(max(1, math.ceil(len(known) / 2)))
        t, w = (t + 1) / 2, w / 2
        factors = [z * (1 - t) + is_known[:, None] * t for z, is_known in known.values()]
        product = math.prod(factors)
        for (f, (z, is_known)), factor in zip(known.items(), factors):
            out[:, f] += ((is_known - z) * ((product / factor) @ w))[:, None] * value

    def _look_up(self, x, out) -> None:
        """The rows of the parts' tables, added to ``out``."""
        columns = np.ascontiguousarray(x.T)
        total = np.zeros((len(x), out.shape[1] * out.shape[2]))
        found = np.empty_like(total)
        for root in self.roots:
            todo = [(root, np.zeros(len(x), np.intp), {})]
            while todo:
                node, mask, place = todo.pop()
                table = self.parts.get(int(node))
                if table is None:
                    f = int(self.feature[node])
                    left = columns[f] <= self.threshold[node]
                    for child, here in ((self.left[node], left), (self.right[node], ~left)):
                        if f in place:
                            todo.append((child, np.where(here, mask, mask & ~(1 << place[f])), place))
                        else:
                            todo.append((child, mask + (here.astype(np.intp) << len(place)), {**place, f: len(place)}))
                    continue
                at = mask.copy()
                for i, split in enumerate(self._splits(node)):
                    at += (columns[self.feature[split]] <= self.threshold[split]).astype(np.intp) << (len(place) + i)
                np.take(table, at, axis=0, out=found, mode="clip")
                total += found
        out += total.reshape(out.shape)


def _nodes(spark: SparkSession, model) -> DataFrame:
    """(tree, weight, id, ...) of a forest or boosted model, from its own saved form."""
    path = new_folder(spark, "trees")
    model.write().overwrite().save(path)
    # three columns: the tree's number, its settings, its weight
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "settings", "weight").drop("settings")
    # One row for each tree.
    return spark.read.parquet(f"{path}/data").join(F.broadcast(weights), "treeID").select("treeID", "weight", "nodeData.*")


def tree_ensemble(spark: SparkSession, model) -> TreeEnsemble:
    """The nodes of a forest, a boosted regression, or a one-vs-rest of boosted classifiers (outputs: its margins)."""
    from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
    from pyspark.ml.regression import RandomForestRegressionModel

    parts = model.models if isinstance(model, OneVsRestModel) else [model]
    forest = isinstance(model, (RandomForestClassificationModel, RandomForestRegressionModel))
    classes = model.numClasses if isinstance(model, RandomForestClassificationModel) else len(parts)
    columns: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "cover", "value", "depth")}
    roots, total = [], 0
    for output, part in enumerate(parts):
        table = _nodes(spark, part)
        total += table.count()
        if total > MOST_NODES:
            raise ValueError(f"An ensemble of more than {MOST_NODES} nodes is too large to be sent to every executor")
        nodes = table.orderBy("treeID", "id").toPandas()
        for _, tree in nodes.groupby("treeID", sort=True):
            base = len(columns["feature"])
            roots.append(base)
            depth = np.zeros(len(tree), int)
            for n, r in enumerate(tree.itertuples()):
                leaf = r.leftChild < 0
                value = np.zeros(classes)
                if leaf and isinstance(model, RandomForestClassificationModel):
                    value[:] = np.asarray(r.impurityStats) / max(sum(r.impurityStats), 1e-300) / model.getNumTrees
                elif leaf:
                    value[output] = r.prediction * (1 / part.getNumTrees if forest else r.weight)
                feature, threshold, left, right = -1, np.nan, base, base
                if not leaf:
                    depth[r.leftChild] = depth[r.rightChild] = depth[n] + 1
                    feature, left, right = r.split["featureIndex"], base + r.leftChild, base + r.rightChild
                    threshold = float(r.split["leftCategoriesOrThreshold"][0])
                    if r.split["numCategories"] >= 0:
                        if r.split["numCategories"] != 2 or len(r.split["leftCategoriesOrThreshold"]) != 1:
                            raise ValueError("Splits by category are supported for slots of 0 and 1 only")
                        # Only the listed value, 0 or 1, goes left; a share between them, as a centre has, goes right.
                        if threshold == 1:
                            left, right, threshold = right, left, np.nextafter(1.0, 0.0)
                for key, v in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right), ("cover", float(r.rawCount)), ("value", value)):
                    columns[key].append(v)
            columns["depth"].append(int(depth.max()))
    arrays = {k: np.array(v) for k, v in columns.items() if k != "depth"}
    return TreeEnsemble(roots=np.array(roots), depth=max(columns["depth"]), intercept=np.zeros(classes), **arrays)


def shapley_column(spark: SparkSession, ensemble: TreeEnsemble, slots: int, features: str = "features") -> Column:
    """Array of outputs, each an array of the ``slots`` features' Shapley values."""
    shared = spark.sparkContext.broadcast(ensemble.tabulate(slots))

    @F.arrow_udf("array<array<double>>")
    def values(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)
        found = shared.value.shapley(rows).transpose(0, 2, 1)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, slots, dtype=np.int32)), pa.array(found.reshape(-1)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, found.shape[1], dtype=np.int32)), inner)

    return values(vector_to_array(features))
