"""Probabilities from margins (Platt scaling): a logistic curve for each class, fitted on margins of rows that the model has not seen."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from dayprint.sources.workdir import materialise


def out_of_fold_margins(estimator, encoded: DataFrame, folds: int = 3, raw: str = "rawPrediction") -> DataFrame:
    """(label, margins) of every encoded row, each from a fit without the row's fold; stored.

    Folds go by a hash of the features, so equal rows are never on both sides.
    """
    dealt = encoded.withColumn("calibration_fold", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(folds)))
    parts = []
    for i in range(folds):
        held = dealt.where(F.col("calibration_fold") == i)
        others = dealt.where(F.col("calibration_fold") != i)
        model = estimator.fit(others)
        parts.append(model.transform(held).select("label", vector_to_array(raw).alias("margins")))
    return materialise(reduce(DataFrame.unionAll, parts), "margins")


def platt_scaling(margins: DataFrame, classes: int) -> list[list[float]]:
    """For each class (slope, intercept) of its logistic curve over the class's margin.

    A class that all or no rows have gets a curve without a slope, at one row more or less.
    """
    counts = margins.agg(F.count(F.lit(1)), *[F.count_if(F.col("label") == c) for c in range(classes)]).first()
    out = []
    for c in range(classes):
        n, own = counts[0], counts[1 + c]
        if own in (0, n):
            odds = (own + 1) / (n - own + 1)
            out.append([0.0, math.log(odds)])
            continue
        rows = margins.select((F.col("label") == c).cast("double").alias("label"), array_to_vector(F.array(F.get("margins", F.lit(c)))).alias("features"))
        fit = LogisticRegression(maxIter=200, regParam=0.0, tol=1e-12).fit(rows)
        out.append([float(fit.coefficients[0]), float(fit.intercept)])
    return out


def scaled_probabilities(margins: Column, curves: list[list[float]]) -> Column:
    """Each class's curve at its margin, scaled to add up to one."""
    # A class beyond those of the fit has no margin, only a chance.
    margin = lambda c: F.coalesce(F.get(margins, F.lit(c)), F.lit(0.0))
    own = [1 / (1 + F.exp(-(F.lit(a) * margin(c) + F.lit(b)))) for c, (a, b) in enumerate(curves)]
    total = reduce(lambda x, y: x + y, own)
    # All curves may vanish far out; then the classes are as likely as each other.
    return F.array(*[F.when(total > 0, p / total).otherwise(F.lit(1.0 / len(curves))) for p in own])
