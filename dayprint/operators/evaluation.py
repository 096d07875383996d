"""Evaluation of predictions: every metric is one or two aggregations."""

from pyspark.sql import DataFrame, Window, functions as F

from dayprint.constants import LEVELS
from dayprint.functions.text import text_list
from dayprint.sources.workdir import materialise

SCORES_PER_RANGE = 25_000


def regression_metrics(
    df: DataFrame, label: str, prediction: str, keys: list[str] = []
) -> DataFrame:
    """Error metrics per key in a single pass.

    ``explained_variance`` repeats r2; the textbook value is
    ``explained_variance_true``. ``mape`` skips zero labels.
    """
    y, e = label, f"({label} - {prediction})"
    r2 = f"1 - try_divide(avg({e} * {e}), var_pop({y}))"
    figures = {
        "n": "count(1)",
        "mse": f"avg({e} * {e})",
        "rmse": f"sqrt(avg({e} * {e}))",
        "mae": f"avg(abs({e}))",
        "mape": f"avg(try_divide(abs({e}), abs({y})))",
        "r2": r2,
        "mean_residual": f"avg({e})",
        "std_residual": f"stddev_pop({e})",
        "within_1kg_pct": f"avg(if(abs({e}) <= 1, 1.0D, 0.0D)) * 100",
        "within_2kg_pct": f"avg(if(abs({e}) <= 2, 1.0D, 0.0D)) * 100",
        "explained_variance": r2,
        "explained_variance_true": f"1 - try_divide(var_pop({e}), var_pop({y}))",
    }
    return (
        df.where(f"{label} is not null and {prediction} is not null")
        .groupBy(*keys)
        .agg(*[F.expr(x).alias(name) for name, x in figures.items()])
    )


def confusion_counts(
    df: DataFrame, label: str, prediction: str, keys: list[str] = []
) -> DataFrame:
    """Observed cells of the confusion matrix; a few rows per key."""
    return df.groupBy(
        *keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: list[str] = LEVELS
) -> DataFrame:
    """Dense matrix: every pair of classes, also the empty ones."""
    cells = ", ".join(
        f"named_struct('label', '{a}', 'prediction', '{b}')" for a in classes for b in classes
    )
    # One row holding a list of at most classes x classes counts.
    observed = (
        confusion_counts(df, label, prediction)
        .where(f"label in ({text_list(classes)}) and prediction in ({text_list(classes)})")
        .agg(
            F.expr("map_from_entries(collect_list(struct(struct(label, prediction), n))) as counts")
        )
    )
    return observed.selectExpr("counts", f"explode(array({cells})) as cell").selectExpr(
        "cell.label", "cell.prediction", "coalesce(counts[cell], 0L) as n"
    )


def per_class_metrics(confusion: DataFrame, keys: list[str] = []) -> DataFrame:
    """Precision, recall and F1 of each class that occurs; 0/0 counts as 0."""
    long = confusion.selectExpr(
        *keys,
        "n",
        "label = prediction as hit",
        "stack(2, label, true, prediction, false) as (class, actual)",
    )
    totals = long.groupBy(*keys, "class").agg(
        F.expr("sum(if(actual, n, 0)) as support"),
        F.expr("sum(if(actual, 0, n)) as predicted"),
        F.expr("sum(if(actual and hit, n, 0)) as hits"),
    )
    return (
        totals.withColumns(
            {
                "precision": F.expr("coalesce(try_divide(hits, predicted), 0.0D)"),
                "recall": F.expr("coalesce(try_divide(hits, support), 0.0D)"),
            }
        )
        .withColumn(
            "f1", F.expr("coalesce(try_divide(2 * precision * recall, precision + recall), 0.0D)")
        )
        .select(*keys, "class", "precision", "recall", "f1", "support", "hits")
    )


def classification_metrics(confusion: DataFrame, keys: list[str] = []) -> DataFrame:
    """Accuracy and unweighted class means."""
    return (
        per_class_metrics(confusion, keys)
        .groupBy(*keys)
        .agg(
            F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg("precision").alias("precision_macro"),
            F.avg("recall").alias("recall_macro"),
            F.avg("f1").alias("f1_macro"),
        )
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    classes = per_class_metrics(confusion)
    names = ("precision", "recall", "f1")
    accuracy = {c: "try_divide(sum(hits), sum(support))" for c in names}
    macro = {c: f"avg({c})" for c in names}
    weighted = {c: f"try_divide(sum({c} * support), sum(support))" for c in names}
    rows = ", ".join(
        f"named_struct('class', '{title}', "
        + ", ".join(f"'{c}', {x}" for c, x in figures.items())
        + ", 'support', sum(support))"
        for title, figures in [
            ("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted),
        ]
    )
    totals = classes.agg(F.expr(f"array({rows}) as rows")).selectExpr("inline(rows)")
    return classes.drop("hits").unionByName(totals)


def rank_auc(df: DataFrame, label: str, probabilities: str, keys: list[str] = []) -> DataFrame:
    """One-vs-rest area under the ROC curve of each class.

    ``probabilities`` is a ``map<string,double>``. Rows with equal scores are
    added up first. The distinct scores are then cut into ranges of about
    SCORES_PER_RANGE by boundaries drawn from the scores themselves: totals per
    range tell how many negatives lie lower, and only the scores of one range
    are ordered against each other, wherever the scores crowd. The area is null
    when a class has no positives or no negatives.
    """
    part = [*keys, "class"]
    scored = df.select(
        *keys, F.col(label).alias("label"), F.explode(probabilities).alias("class", "score")
    )
    by_score = scored.groupBy(*part, "score").agg(
        F.count_if(F.col("label") == F.col("class")).alias("pos"),
        F.count_if(F.col("label") != F.col("class")).alias("neg"),
    )
    by_score = materialise(by_score, "scores")
    ranges = by_score.count() // SCORES_PER_RANGE + 1
    by_score = materialise(
        by_score.repartitionByRange(ranges, *part, "score").withColumn("bin", F.spark_partition_id()),
        "score-ranges",
    )
    previous = (Window.unboundedPreceding, -1)
    in_bin = Window.partitionBy(*part, "bin").orderBy("score").rowsBetween(*previous)
    bin_area = (
        by_score.withColumn("lower", F.coalesce(F.sum("neg").over(in_bin), F.lit(0)))
        .groupBy(*part, "bin")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / F.lit(2.0))).alias("area"),
        )
    )
    # As many rows as there are ranges from here on.
    bins = Window.partitionBy(*part).orderBy("bin").rowsBetween(*previous)
    return (
        bin_area.withColumn("lower", F.coalesce(F.sum("neg").over(bins), F.lit(0)))
        .groupBy(*part)
        .agg(
            F.try_divide(
                F.sum(F.col("area") + F.col("pos") * F.col("lower")),
                F.sum("pos").cast("double") * F.sum("neg"),
            ).alias("roc_auc")
        )
    )


def roc_auc_ovr(df: DataFrame, label: str, probabilities: str, keys: list[str] = []) -> DataFrame:
    """Unweighted mean over the classes; null if any class has no area."""
    return (
        rank_auc(df, label, probabilities, keys)
        .groupBy(*keys)
        .agg(
            F.when(F.count("roc_auc") == F.count(F.lit(1)), F.avg("roc_auc")).alias("roc_auc")
        )
    )


def compare_regressors(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One metric row per model of a long frame (algorithm, label, prediction)."""
    return regression_metrics(predictions, label, "prediction", ["algorithm"]).select(
        F.concat("algorithm", F.lit("_regression")).alias("model_name"),
        F.lit("regression").alias("model_type"),
        "*",
    )


def compare_classifiers(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Metric row per model (algorithm, label, prediction, probabilities map)."""
    confusion = confusion_counts(predictions, label, "prediction", ["algorithm"])
    metrics = classification_metrics(confusion, ["algorithm"])
    areas = roc_auc_ovr(
        predictions.withColumnRenamed(label, "label"), "label", "probabilities", ["algorithm"]
    )
    # One row per model on both sides.
    return metrics.join(areas, "algorithm", "left").select(
        F.concat("algorithm", F.lit("_classification")).alias("model_name"),
        F.lit("classification").alias("model_type"),
        "*",
    )


def best_model(
    metrics: DataFrame, metric: str, order: str, higher_is_better: bool = True
) -> DataFrame:
    """Row with the best metric; on a tie the first in ``order``."""
    by = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    return metrics.orderBy(by, order).limit(1)


def leaderboard(metrics: DataFrame, score: str = "r2") -> DataFrame:
    """Train and test scores side by side with their gap.

    Takes tidy rows (task, model, metric, value) whose metrics are named
    ``train_<score>`` and ``test_<score>``.
    """
    wide = (
        metrics.groupBy("task", "model")
        .pivot("metric", [f"train_{score}", f"test_{score}"])
        .agg(F.first("value"))
    )
    return wide.withColumn("overfitting", F.col(f"train_{score}") - F.col(f"test_{score}"))
