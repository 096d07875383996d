"""Voting over the predictions of several models of one record."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dayprint.constants import FOOTPRINT, LEVEL, LEVELS

ENSEMBLE_TYPES = ("voting", "weighted")
# Fixed value: weight of a model without a validation score.
DEFAULT_WEIGHT = 0.5


def check_ensemble_type(ensemble_type: str) -> None:
    if ensemble_type not in ENSEMBLE_TYPES:
        raise ValueError(f"Unknown ensemble type: {ensemble_type}")


def _add(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def vote_mean(predictions: list[Column]) -> Column:
    return _add(predictions) / len(predictions)


def vote_weighted(predictions: list[Column], weights: list[Column | float]) -> Column:
    """Weighted mean; weights need not sum to one."""
    w = [F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit(DEFAULT_WEIGHT)) for x in weights]
    return _add([p * x for p, x in zip(predictions, w)]) / _add(w)


def vote_majority(levels: list[Column], classes: list[str] = LEVELS) -> Column:
    """Most frequent class; on a tie the earliest in ``classes``."""
    votes = F.array(*levels)

    def place(i: int, c: str) -> Column:
        count = F.size(F.filter(votes, lambda v: v == c))
        return F.struct((-count).alias("minus_votes"), F.lit(i).alias("position"), F.lit(c).alias("level"))

    return F.array_min(F.array(*[place(i, c) for i, c in enumerate(classes)]))["level"]


def vote_soft(
    probabilities: list[dict[str, Column]],
    ensemble_type: str = "voting",
    weights: list[Column | float] | None = None,
) -> dict[str, Column]:
    """Mean probability per class; any type but ``weighted`` is a plain mean."""
    classes = list(probabilities[0])
    if ensemble_type == "weighted" and weights is not None:
        return {c: vote_weighted([p[c] for p in probabilities], weights) for c in classes}
    return {c: vote_mean([p[c] for p in probabilities]) for c in classes}


def most_likely(probabilities: dict[str, Column]) -> Column:
    """Class with the largest probability; on a tie the first."""
    ranked = F.array(
        *[
            F.struct((-p).alias("minus_p"), F.lit(i).alias("position"), F.lit(c).alias("level"))
            for i, (c, p) in enumerate(probabilities.items())
        ]
    )
    return F.array_min(ranked)["level"]


@dataclass
class ModelEnsemble:
    """Several trained models of one task that vote on every record."""

    models: list
    ensemble_type: str = "voting"

    @property
    def task(self) -> str:
        return self.models[0].config.model_type

    def weights(self) -> list[float]:
        score = "val_r2" if self.task == "regression" else "val_accuracy"
        return [m.metrics.get(score, DEFAULT_WEIGHT) for m in self.models]

    def _members(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """``df`` with one column per member: its prediction or probabilities."""
        if any(m.model is None for m in self.models):
            raise ValueError("All models in ensemble must be trained")
        names = [f"member_{i}" for i in range(len(self.models))]
        for name, m in zip(names, self.models):
            if self.task == "regression":
                df = m.predict(df).withColumnRenamed(f"{FOOTPRINT}_predicted", name)
            else:
                df = m.predict(df).withColumnsRenamed(
                    {f"{LEVEL}_predicted": name, "class_probabilities": f"{name}_p"}
                )
        return df, names

    def _mean_probabilities(self, names: list[str]) -> dict[str, Column]:
        given = [
            {v: F.expr(f"{n}_p[{i}]") for i, v in enumerate(LEVELS)} for n in names
        ]
        return vote_soft(given, self.ensemble_type, self.weights())

    def with_votes(self, df: DataFrame, votes: dict[str, str]) -> DataFrame:
        """``df`` with ``member_0``, ``member_1`` ... and the named regression votes, each member scored once.

        ``votes`` maps a column's name to the ensemble type of its vote.
        """
        for ensemble_type in votes.values():
            check_ensemble_type(ensemble_type)
        if self.task != "regression":
            raise ValueError("with_votes is only available for regression models")
        out, names = self._members(df)
        return out.withColumns({name: self._vote([F.col(n) for n in names], kind) for name, kind in votes.items()})

    def _vote(self, columns: list[Column], ensemble_type: str) -> Column:
        return vote_mean(columns) if ensemble_type == "voting" else vote_weighted(columns, self.weights())

    def predict(self, df: DataFrame) -> DataFrame:
        """Mean or weighted mean; for classes majority or weighted soft vote."""
        check_ensemble_type(self.ensemble_type)
        out, names = self._members(df)
        columns = [F.col(n) for n in names]
        if self.task == "classification":
            vote = (
                vote_majority(columns)
                if self.ensemble_type == "voting"
                else most_likely(self._mean_probabilities(names))
            )
            return out.select(*df.columns, vote.alias(f"{LEVEL}_predicted"))
        vote = self._vote(columns, self.ensemble_type)
        return out.select(*df.columns, vote.alias(f"{FOOTPRINT}_predicted"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Mean or weighted mean of the members' class probabilities."""
        if self.task != "classification":
            raise ValueError("predict_proba is only available for classification models")
        out, names = self._members(df)
        mean = self._mean_probabilities(names)
        return out.select(*df.columns, F.array(*mean.values()).alias("class_probabilities"))
