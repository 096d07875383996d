"""Training job: read, split, train all algorithms, evaluate, choose, save.

    spark-submit dayprint/plans/train_job.py --data PATH --output-dir DIR
"""

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayprint.constants import FOOTPRINT, USER_KEY
from dayprint.operators import model_store
from dayprint.operators.profile import stat_rows
from dayprint.operators.splits import hash_split, stratified_split
from dayprint.operators.training import TRAIN_ALL, TrainedModel, evaluate_all, train_all
from dayprint.session import build_session
from dayprint.sources.files import read_activity


def prepare_features(df: DataFrame) -> DataFrame:
    """Features and targets without the user key."""
    return df.drop(USER_KEY)


def target_profile(df: DataFrame) -> DataFrame:
    """Target statistics in the form of metrics."""
    row = df.agg(
        F.avg(FOOTPRINT).alias("mean"),
        F.stddev_samp(FOOTPRINT).alias("std"),
        F.min(FOOTPRINT).alias("min"),
        F.max(FOOTPRINT).alias("max"),
    )
    return stat_rows(row, "target").selectExpr(
        "section as task", "'profile' as model", "name as metric", "value"
    )


def choose_best(metrics: list, task: str, metric: str) -> str:
    """Model with the largest value of a metric; the first one on a tie."""
    scores = [r for r in metrics if r["task"] == task and r["metric"] == metric]
    return max(scores, key=lambda r: r["value"])["model"]


def run(
    spark: SparkSession,
    df: DataFrame,
    output_dir: str,
    key: str,
    test_size: float = 0.2,
    exact_split: bool = True,
    algorithms: tuple[str, ...] = TRAIN_ALL,
    hyperparameters: dict | None = None,
) -> dict[str, TrainedModel]:
    """Train and publish everything as a new version of ``output_dir``; gives the models.

    ``key`` identifies a row and decides its side of the split.
    """
    if exact_split:
        rows = stratified_split(df, key, test_size=test_size, store_limits=True)
    else:
        rows = hash_split(df, key, test_size)
    train = rows.where("split = 'train'")
    test = rows.where("split = 'test'")
    models = train_all(train, algorithms, hyperparameters=hyperparameters)
    # A few figures per model.
    metrics = evaluate_all(models, test).collect()
    best = {
        "regression": choose_best(metrics, "regression", "r2"),
        "classification": choose_best(metrics, "classification", "accuracy"),
    }
    stored = spark.createDataFrame(metrics).unionByName(target_profile(train))
    names = {task: f"{task}_{name}" for task, name in best.items()}
    model_store.publish_models(spark, models, output_dir, names, stored)
    return models


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--data", required=True)
    parser.add_argument("--format", default="csv")
    parser.add_argument("--output-dir", default="models")
    parser.add_argument("--test-size", type=float, default=0.2)
    parser.add_argument("--split", choices=("exact", "hash"), default="exact")
    args = parser.parse_args()
    spark = build_session("dayprint-train")
    rows = read_activity(spark, args.data, args.format)
    # Rows have no key of their own, so the whole record identifies them.
    keyed = rows.withColumn("row_key", F.sha2(F.to_json(F.struct("*")), 256))
    run(spark, prepare_features(keyed), args.output_dir, "row_key", args.test_size,
        args.split == "exact")
    spark.stop()


if __name__ == "__main__":
    main()
