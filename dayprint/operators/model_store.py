"""Saved models, their registry and their metrics."""

import json

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dayprint.constants import LEVEL, LEVELS, REQUIRED_ARTEFACTS
from dayprint.operators.training import ModelConfig, TrainedModel
from dayprint.schema import METRIC_SCHEMA
from dayprint.sources.published import new_part, part_path, publish, published

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("loadable", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def list_artefacts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the saved objects of a folder, sorted."""
    hadoop_path, fs = _file_system(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    return sorted(
        s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory()
    )


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def save_model(spark: SparkSession, trained: TrainedModel, folder: str, name: str | None = None) -> str:
    """Save as ``<task>_<algorithm>`` (or ``name``): preprocessor, model, settings."""
    path = f"{folder}/{name or trained.name}"
    trained.preprocessor.write().overwrite().save(f"{path}/preprocessor")
    trained.model.write().overwrite().save(f"{path}/model")
    _write_text(
        spark,
        f"{path}/settings",
        json.dumps({"config": trained.config.to_dict(), "metrics": trained.metrics, "calibration": trained.calibration}),
    )
    return path


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Model file not found: {path}")
    settings = json.loads(_read_text(spark, f"{path}/settings"))
    return TrainedModel(
        ModelConfig.from_dict(settings["config"]),
        PipelineModel.load(f"{path}/preprocessor"),
        DefaultParamsReader.loadParamsInstance(f"{path}/model", spark),
        settings["metrics"],
        settings.get("calibration"),
    )


def label_codec(spark: SparkSession) -> StringIndexerModel:
    """Level to class number with the fixed order Low, Medium, High."""
    return StringIndexerModel.from_labels(
        LEVELS, inputCol=LEVEL, outputCol="label", handleInvalid="keep"
    )


def save_models(
    spark: SparkSession,
    models: dict[str, TrainedModel],
    folder: str,
    best: dict[str, str] | None = None,
) -> None:
    """Save all models, the preprocessor, the label codec and the best models.

    ``best`` maps a task to the name of its best model.
    """
    for m in models.values():
        save_model(spark, m, folder)
    any_model = next(iter(models.values()))
    any_model.preprocessor.write().overwrite().save(f"{folder}/preprocessor")
    label_codec(spark).write().overwrite().save(f"{folder}/label_encoder")
    for task, name in (best or {}).items():
        save_model(spark, models[name], folder, f"best_{task}_model")


def publish_models(
    spark: SparkSession,
    models: dict[str, TrainedModel],
    folder: str,
    best: dict[str, str] | None = None,
    metrics: DataFrame | None = None,
) -> str:
    """Save a whole set as a new version of ``folder`` and gives its name.

    The version is visible once everything, its metrics too, is written.
    Earlier versions stay as they are, for readers that hold on to them.
    """
    version = new_part()
    path = part_path(folder, version)
    save_models(spark, models, path, best)
    if metrics is not None:
        write_metrics(metrics, f"{path}/metrics")
    publish(spark, folder, version)
    return version


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions of a model folder in the order of their publication; the last one is current."""
    return published(spark, folder)


def roll_back(spark: SparkSession, folder: str, version: str) -> None:
    """Make an earlier version the current one."""
    if version not in versions(spark, folder):
        raise ValueError(f"No such version: {version}")
    publish(spark, folder, version)


def version_path(spark: SparkSession, folder: str, version: str | None = None) -> str:
    """Where a version (the current one by default) lies; a reader keeps this path while it works.

    A folder without versions is a plain set of saved models.
    """
    known = versions(spark, folder)
    if version is None:
        return part_path(folder, known[-1]) if known else folder
    if version not in known:
        raise ValueError(f"No such version: {version}")
    return part_path(folder, version)


def load_all(spark: SparkSession, folder: str) -> dict[str, TrainedModel]:
    """Every saved model; the best ones are named ``best_<task>``."""
    found = {}
    for name in list_artefacts(spark, folder):
        if name.startswith(("regression_", "classification_", "best_")):
            found[name.removesuffix("_model")] = load_model(spark, f"{folder}/{name}")
    return found


def folder_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry of a folder: every saved object and whether it loads."""
    rows = []
    for name in list_artefacts(spark, folder):
        path, error = f"{folder}/{name}", None
        try:
            if path_exists(spark, f"{path}/model"):
                load_model(spark, path)
            elif path_exists(spark, f"{path}/metadata"):
                DefaultParamsReader.loadParamsInstance(path, spark)
            else:
                error = "Not a saved model"
        except Exception as e:  # The report lists the reason.
            error = str(e).splitlines()[0]
        rows.append((name, error is None, error))
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def audit(registry: DataFrame, required: list[str] = REQUIRED_ARTEFACTS) -> DataFrame:
    """For each required object: does it exist, does it load, and why not."""
    wanted = registry.sparkSession.createDataFrame(
        list(enumerate(required)), "position int, name string"
    )
    # Only the required names can match.
    known = F.broadcast(registry.where(F.col("name").isin(required)))
    return wanted.join(known, "name", "left").select(
        "position",
        "name",
        F.col("loadable").isNotNull().alias("exists"),
        F.coalesce("loadable", F.lit(False)).alias("loadable"),
        F.when(
            ~F.coalesce("loadable", F.lit(False)), F.coalesce("error", F.lit("File not found"))
        ).alias("error"),
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select(*METRIC_SCHEMA.names).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored metrics; a missing store is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], METRIC_SCHEMA)
    return spark.read.schema(METRIC_SCHEMA).json(path)


def filter_models(registry: DataFrame, model_type: str | None = None) -> DataFrame:
    """Models whose name contains ``model_type``, in any case."""
    if model_type is None:
        return registry
    return registry.where(F.lower("name").contains(model_type.lower()))


def resolve_model(names: list[str], task: str, wanted: str = "best") -> str:
    """Name of the model that serves a request.

    ``best`` takes the best model or else the first of the task. A name of the
    task must exist; any other request takes the first model of the task.
    """
    prefix = f"{task}_"
    of_task = [n for n in names if n.startswith(prefix)]
    if wanted == "best" and f"best_{task}" in names:
        return f"best_{task}"
    if wanted.startswith(prefix):
        if wanted not in names:
            raise ValueError(f"Model {wanted} not found")
        return wanted
    if not of_task:
        raise ValueError(f"No {task} models available")
    return of_task[0]


def strict_model(names: list[str], wanted: str) -> str:
    """The model with exactly this name."""
    if wanted not in names:
        raise ValueError(f"Model {wanted} not found. Available: {list(names)}")
    return wanted


def model_info(registry: DataFrame, metrics: DataFrame, best: DataFrame) -> DataFrame:
    """One row per model with its task, its metrics and whether it is the best.

    ``registry`` holds names like ``regression_linear``; ``best`` has the
    columns task and model.
    """
    parts = F.split("name", "_", 2)
    named = registry.select("name", parts[0].alias("task"), parts[1].alias("model"))
    return (
        named.join(metrics, ["task", "model"], "left")
        .join(best.withColumn("is_best", F.lit(True)), ["task", "model"], "left")
        .withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    )
