"""Shapley values of any model by weighted least squares over sampled coalitions, with an error estimate.

A coalition takes some features from the record and the others from a background of few weighted centres; its value is
the mean prediction over the centres. Small and large coalitions are listed whole as far as the budget goes, because the Shapley
kernel weighs them most; the sizes in between are drawn in pairs of complements, dealt into batches. All records use the
same coalitions, so the least-squares solution under "values add up to the prediction minus the background's" is one fixed
matrix for each batch: a record's values are a product with it. The mean over the batches is the estimate, their spread its
standard error; where all coalitions are listed the values are exact and the error is zero.

Records stay where they are. The combinations of a record with the centres exist only inside a task, a block at a time.

Of a tree with few splits a record matters only by the side it takes at each split, and the least squares are linear in the coalition
values. So what every combination of sides adds to a record's values, for all coalitions and centres, is worked out once; a record then
adds up one row of a table for each tree. Ensembles whose tables would be too large are predicted on the combined rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, SparkSession, functions as F

from dayprint.operators.kernel_features import FourierMap
from dayprint.operators.tree_tables import MOST_TABLE, ROWS_AT_ONCE, TreeEnsemble, tree_ensemble

#: Combined rows that a task holds at once.
BLOCK_ROWS = 50_000
#: Splits of a tree whose combinations of sides are listed at most.
LISTED_SPLITS = 10


@dataclass
class LinearOutputs:
    """Predictions of linear, robust and logistic models outside the JVM."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    softmax: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.coefficients.T + self.intercepts
        if self.softmax:
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
        return out


@dataclass
class Mapped:
    """Outputs of a model behind a feature map."""

    mapped: object
    inner: object

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.inner.predict(self.mapped(x))


def outputs_of(spark: SparkSession, model):
    """An object whose ``predict`` turns encoded rows into (rows, outputs)."""
    if isinstance(model, PipelineModel):
        front, solver = model.stages
        settings = [front.getOrDefault(k) for k in ("components", "gamma", "seed")]
        return Mapped(FourierMap(*settings), outputs_of(spark, solver))
    if hasattr(model, "coefficientMatrix"):
        return LinearOutputs(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), softmax=True)
    if hasattr(model, "coefficients"):
        return LinearOutputs(model.coefficients.toArray()[None, :], np.array([model.intercept]))
    if hasattr(model, "models") and hasattr(model.models[0], "coefficients"):
        return LinearOutputs(np.stack([m.coefficients.toArray() for m in model.models]), np.array([m.intercept for m in model.models]))
    return tree_ensemble(spark, model)


def coalitions(features: int, budget: int, batches: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each batch the coalitions (n, features) and their weights; one batch if all are listed."""
    mass = {s: (features - 1) / (s * (features - s)) for s in range(1, features)}  # of all coalitions of a size
    listed: list[np.ndarray] = []
    weights: list[float] = []
    left, open_sizes = budget, sorted(mass, key=lambda s: (min(s, features - s), s))
    while open_sizes:
        low = min(open_sizes[0], features - open_sizes[0])
        sizes = sorted({low, features - low})
        count = sum(math.comb(features, s) for s in sizes)
        if count > left:
            break
        for s in sizes:
            for chosen in combinations(range(features), s):
                row = np.zeros(features, bool)
                row[list(chosen)] = True
                listed.append(row)
                weights.append(mass[s] / math.comb(features, s))
        left -= count
        open_sizes = [s for s in open_sizes if s not in sizes]
    whole = (np.array(listed, bool).reshape(-1, features), np.array(weights))
    if not open_sizes:
        return [whole]
    draw = np.random.default_rng(seed)
    chance = np.array([mass[s] for s in open_sizes])
    total = chance.sum()
    pairs = max(1, left // 2 // batches)
    out = []
    for _ in range(batches):
        rows = []
        for s in draw.choice(open_sizes, pairs, p=chance / total):
            row = np.zeros(features, bool)
            row[draw.choice(features, s, replace=False)] = True
            rows += [row, ~row]
        out.append((np.concatenate([whole[0], np.array(rows)]), np.concatenate([whole[1], np.full(len(rows), total / len(rows))])))
    return out


def solution(chosen: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, b): the values are A @ (coalition values - base) + b * (prediction - base)."""
    last = chosen[:, -1].astype(float)
    x = chosen[:, :-1].astype(float) - last[:, None]
    left = np.linalg.pinv(x.T @ (weights[:, None] * x)) @ (x.T * weights)
    first_b = -left @ last
    return np.vstack([left, -left.sum(0)]), np.append(first_b, 1 - first_b.sum())


@dataclass
class KernelExplainer:
    model: object
    centres: np.ndarray
    shares: np.ndarray
    plans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    # For each tree its splits and the rows (combinations of sides, batches * features * outputs), if `tabulate` found room for them.
    tables: list[tuple[list[int], np.ndarray]] | None = None

    @classmethod
    def of(cls, model, centres: list[tuple[list, int]], budget: int = 512, batches: int = 8, seed: int = 42) -> KernelExplainer:
        points, sizes = np.array([c for c, _ in centres], float), np.array([n for _, n in centres], float)
        features = points.shape[1]
        if features == 1:
            return cls(model, points, sizes / sizes.sum(), [(np.zeros((0, 1), bool), np.zeros((1, 0)), np.ones(1))])
        return cls(model, points, sizes / sizes.sum(), [(z, *solution(z, w)) for z, w in coalitions(features, budget, batches, seed)])

    @property
    def base(self) -> np.ndarray:
        return self.shares @ self.model.predict(self.centres)

    def coalition_values(self, x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """(rows, coalitions, outputs)."""
        outputs = len(self.base)
        out = np.empty((len(x), len(chosen), outputs))
        step = max(1, BLOCK_ROWS // len(self.centres) // max(1, len(x)))
        for at in range(0, len(chosen), step):
            z = chosen[at : at + step]
            mixed = np.where(z[None, :, None, :], x[:, None, None, :], self.centres[None, None, :, :])
            values = self.model.predict(mixed.reshape(-1, x.shape[1])).reshape(len(x), len(z), len(self.centres), outputs)
            out[:, at : at + step] = np.einsum("rzck,c->rzk", values, self.shares)
        return out

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and standard errors, each (rows, features, outputs)."""
        if self.tables is not None:
            parts = [self._look_up(x[at : at + ROWS_AT_ONCE]) for at in range(0, len(x), ROWS_AT_ONCE)]
            return self._joined(parts)
        rows = max(1, BLOCK_ROWS // len(self.centres) // 64)
        parts = [self._explain(x[at : at + rows]) for at in range(0, len(x), rows)]
        return self._joined(parts)

    def _joined(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        empty = np.zeros((0, self.centres.shape[1], len(self.base)))
        return tuple(np.concatenate([p[k] for p in parts]) if parts else empty for k in (0, 1))

    def tabulate(self) -> KernelExplainer:
        """Fill `tables` for an ensemble of trees, unless they are larger than `MOST_TABLE`."""
        if not isinstance(self.model, TreeEnsemble) or self.centres.shape[1] == 1:
            return self
        splits = [self._splits(root) for root in self.model.roots]
        width = len(self.plans) * self.centres.shape[1] * len(self.model.intercept)
        if any(len(s) > LISTED_SPLITS for s in splits) or sum(width << len(s) for s in splits) > MOST_TABLE:
            return self
        self.tables = [(s, self._table(root, s)) for root, s in zip(self.model.roots, splits)]
        return self

    def _splits(self, root: int) -> list[int]:
        found, todo = [], [int(root)]
        while todo:
            node = todo.pop()
            if self.model.feature[node] >= 0:
                found.append(node)
                todo += [int(self.model.left[node]), int(self.model.right[node])]
        return found

    def _table(self, root: int, splits: list[int]) -> np.ndarray:
        """(combinations, batches * features * outputs); bit i is whether the record goes left at the i-th split."""
        model = self.model
        sides = (np.arange(1 << len(splits))[:, None] >> np.arange(len(splits))) & 1 == 1
        centre_sides = np.stack([model.goes_left(n, self.centres) for n in splits], 1) if splits else np.zeros((len(self.centres), 0), bool)
        place = {n: i for i, n in enumerate(splits)}
        features = self.centres.shape[1]

        def values(z: np.ndarray) -> np.ndarray:
            """(combinations, outputs): the tree's mean output over the centres where a coalition z comes from the record."""

            def below(node: int, here: np.ndarray) -> np.ndarray:
                if model.feature[node] < 0:
                    return (here @ self.shares)[:, None] * model.value[node]
                i = place[node]
                left = sides[:, i : i + 1] if z[model.feature[node]] else centre_sides[None, :, i]
                return below(int(model.left[node]), here & left) + below(int(model.right[node]), here & ~left)

            return below(int(root), np.ones((len(sides), len(self.centres)), bool))

        full, known = values(np.ones(features, bool)), {}
        out = []
        for z, a, b in self.plans:
            mine = [known[k] if (k := row.tobytes()) in known else known.setdefault(k, values(row)) for row in z]
            out.append(np.einsum("fz,zpk->pfk", a, np.stack(mine)) + b[None, :, None] * full[:, None, :])
        return np.stack(out, 1).reshape(len(sides), -1)

    def _look_up(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        model, columns = self.model, np.ascontiguousarray(x.T)
        left_over = model.intercept - self.base
        constant = [(a.sum(1) + b)[:, None] * left_over for _, a, b in self.plans]
        total = np.tile(np.stack(constant).reshape(1, -1), (len(x), 1))
        for splits, table in self.tables:
            at = np.zeros(len(x), np.intp)
            for i, node in enumerate(splits):
                at += (columns[model.feature[node]] <= model.threshold[node]).astype(np.intp) << i
            total += table[at]
        return self._summary(total.reshape(len(x), len(self.plans), x.shape[1], -1).swapaxes(0, 1))

    @staticmethod
    def _summary(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean over the batches and its standard error."""
        spread = found.std(0, ddof=1) / math.sqrt(len(found)) if len(found) > 1 else np.zeros(found.shape[1:])
        return found.mean(0), spread

    def _explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, full = self.base, self.model.predict(x)
        shared = 0
        if len(self.plans) > 1:  # the listed coalitions lead every batch and are scored once
            first = self.plans[0][0]
            same = [int(np.argmin(np.append((first[: len(z)] == z[: len(first)]).all(1), False))) for z, _, _ in self.plans[1:]]
            shared = min(same)
        common = self.coalition_values(x, self.plans[0][0][:shared])
        found = []
        for z, a, b in self.plans:
            values = np.concatenate([common, self.coalition_values(x, z[shared:])], 1) - base
            found.append(np.einsum("fz,rzk->rfk", a, values) + b[None, :, None] * (full - base)[:, None, :])
        return self._summary(np.stack(found))


def kernel_columns(spark: SparkSession, explainer: KernelExplainer, features: str = "features") -> Column:
    """struct(values, errors): for each output an array over the features."""
    shared = spark.sparkContext.broadcast(explainer.tabulate())

    @F.arrow_udf("values array<array<double>>, errors array<array<double>>")
    def explained(x: pa.Array) -> pa.Array:
        slots = shared.value.centres.shape[1]
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, slots)

        def listed(found: np.ndarray) -> pa.Array:
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, slots, dtype=np.int32)), pa.array(np.ascontiguousarray(found.swapaxes(1, 2)).reshape(-1)))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, found.shape[2], dtype=np.int32)), inner)

        return pa.StructArray.from_arrays([listed(found) for found in shared.value.explain(rows)], ["values", "errors"])

    return explained(vector_to_array(features))
