"""Scoring service as DataFrame jobs: load models once, score any table."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayprint.constants import FOOTPRINT, LEVEL
from dayprint.functions.contributions import (
    SERVICE_FACTORS,
    key_factors,
    service_contributions,
    top_factors,
    with_contributions,
    with_ranked_shares,
)
from dayprint.functions.explanations import explanation, service_explanation
from dayprint.functions.validation import coerce_numeric, validation_errors
from dayprint.operators import model_store
from dayprint.operators.scoring import score_batch, score_distinct, with_plausibility
from dayprint.operators.training import TrainedModel, ml_scorer
from dayprint.sources.files import read_raw_csv, write_scored


@dataclass
class Predictor:
    """Models of one folder with the statistics of their training target."""

    models: dict[str, TrainedModel]
    stats: dict | None = None
    metrics: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: str | None = None) -> "Predictor":
        """The current version of a model folder, or the one named; later publications do not change it."""
        folder = model_store.version_path(spark, folder, version)
        metrics = model_store.read_metrics(spark, f"{folder}/metrics")
        found = metrics.where("task = 'target' and model = 'profile'")
        # At most four rows.
        stats = {r["metric"]: r["value"] for r in found.collect()} or None
        return cls(model_store.load_all(spark, folder), stats, metrics)

    def _pair(self, regression: str, classification: str) -> tuple[TrainedModel, TrainedModel]:
        names = list(self.models)
        return (
            self.models[model_store.strict_model(names, regression)],
            self.models[model_store.strict_model(names, classification)],
        )

    def score(
        self,
        df: DataFrame,
        regression_model: str = "best_regression",
        classification_model: str = "best_classification",
        timestamp: Column | None = None,
        distinct: bool = False,
    ) -> DataFrame:
        """Scored rows with confidence, suggestions and contributions.

        Invalid rows carry their error. With ``distinct`` equal inputs are
        scored once.
        """
        scorer = ml_scorer(*self._pair(regression_model, classification_model))
        if distinct:
            once = scorer
            scorer = lambda rows: score_distinct(rows, once)
        return score_batch(df, scorer, self.stats, timestamp)

    def serve(
        self, df: DataFrame, model: str = "best", timestamp: Column | None = None
    ) -> DataFrame:
        """The service's form: its own texts and weights, and a plausibility block."""
        names = list(self.models)
        pair = [
            self.models[model_store.resolve_model(names, task, model)]
            for task in ("regression", "classification")
        ]
        return with_plausibility(
            score_batch(df, ml_scorer(*pair), None, timestamp, variant="service")
        )

    def validate_and_score(self, df: DataFrame) -> DataFrame:
        """Like ``score``, with all messages of a record as an array."""
        return self.score(df.withColumn("error_messages", validation_errors()))

    def explain(self, df: DataFrame, variant: str = "core") -> DataFrame:
        """Scored rows with ranked shares, main factors and an explanation."""
        if variant == "core":
            ranked = with_ranked_shares(with_contributions(self.score(df)))
        else:
            parts = self.serve(df).withColumn("contributions", service_contributions())
            ranked = with_ranked_shares(parts, factors=SERVICE_FACTORS, places=None)
        if variant == "core":
            factors = top_factors("shares")
            text = explanation(FOOTPRINT, LEVEL, "shares")
            published = F.col("shares")
        else:
            factors = key_factors("shares")
            text = service_explanation(FOOTPRINT, LEVEL, "shares")
            published = top_factors("shares", 5)
        ok = F.col("error").isNull()
        return ranked.withColumns(
            {
                "top_factors": F.when(ok, factors),
                "explanation": F.when(ok, text),
                "percentage_contributions": F.when(ok, published),
            }
        ).drop("contributions", "shares")

    def score_csv(self, spark: SparkSession, path: str, output: str | None = None) -> DataFrame:
        """Score a csv file with a header; optionally store the result as csv."""
        scored = self.serve(coerce_numeric(read_raw_csv(spark, path)))
        if output is not None:
            write_scored(scored, output, "csv")
        return scored
