"""Random Fourier features: a finite map whose dot products approach the Gaussian kernel exp(-gamma * distance^2).

A linear solver behind this stage is a kernel machine whose size does not grow with the rows. Directions and phases follow from
(seed, components, width), so only these and gamma are saved with the model.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F


def fourier_map(x: np.ndarray, components: int, gamma: float, seed: int) -> np.ndarray:
    """(rows, components): sqrt(2 / components) * cos(x @ directions + phases)."""
    draw = np.random.Generator(np.random.PCG64(seed))
    directions = draw.standard_normal((x.shape[1], components)) * np.sqrt(2 * gamma)
    phases = draw.uniform(0, 2 * np.pi, components)
    return np.sqrt(2 / components) * np.cos(x @ directions + phases)


@dataclass
class FourierMap:
    components: int
    gamma: float
    seed: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return fourier_map(x, self.components, self.gamma, self.seed)


class _Settings(Params):
    inputCol = Param(Params._dummy(), "inputCol", "encoded rows", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "mapped rows", TypeConverters.toString)
    components = Param(Params._dummy(), "components", "width of the map", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel; 0 learns it", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)


class FourierFeatures(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns gamma as 1 / (slots * variance of all encoded values), or takes the one given."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, components=None, gamma=None, seed=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", components=256, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        gamma = self.getOrDefault("gamma")
        if not gamma:
            values = dataset.select(vector_to_array(self.getOrDefault("inputCol")).alias("x"))
            # Sums inside the row first: one pair of numbers leaves each row.
            add = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, v: a + v)
            n, s, q, width = values.agg(F.sum(F.size("x")), F.sum(add(lambda v: v)), F.sum(add(lambda v: v * v)), F.max(F.size("x"))).first()
            variance = q / n - (s / n) ** 2 if n else 0.0
            gamma = 1 / (width * variance) if variance > 0 else 1.0
        settings = {k: self.getOrDefault(k) for k in ("inputCol", "outputCol", "components", "seed")}
        return FourierFeaturesModel(**settings, gamma=float(gamma))


class FourierFeaturesModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, components=None, gamma=None, seed=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        components, gamma, seed = (self.getOrDefault(k) for k in ("components", "gamma", "seed"))

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(fourier_map(np.stack(x.to_numpy()), components, gamma, seed)) if len(x) else [])

        rows = array_to_vector(mapped(vector_to_array(self.getOrDefault("inputCol"))))
        return dataset.withColumn(self.getOrDefault("outputCol"), rows)
