"""Headline queries: prints one JSON line with seconds per query.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

import json
import os
import sys
import tempfile
import time

from dayprint.plans.catalogue import QUERIES
from dayprint.session import build_session
from dayprint.sources.workdir import release

HEADLINE = [
    "read_activity",
    "validate_all",
    "quarantine",
    "engineer_features",
    "preprocess",
    "stratified_split",
    "hash_split",
    "kfold_regression",
    "score_batch",
    "score_batch_ml",
    "score_distinct",
    "stream_score",
    "suggestions_core",
    "contribution_pct",
    "explain_text",
    "plausibility_checks",
    "regression_metrics",
    "classification_report",
    "roc_auc_ovr",
    "compare_models",
    "analyze_predictions",
    "describe",
    "correlation_matrix",
    "box_stats",
    "value_counts",
    "impact_by_mode",
    "rf_regressor",
    "logistic_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "dayprint-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="dayprint-bench-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the engine before the clock runs.
    QUERIES["impact_by_mode"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        release(spark)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "scored_rows_per_sec": round(rows / seconds["score_batch"])
                if "score_batch" in seconds
                else None,
            }
        )
    )


if __name__ == "__main__":
    main()
