from pyspark.sql import functions as F

from dayprint.constants import FEATURES, FOOTPRINT
from dayprint.schema import FEATURE_SCHEMA
from dayprint.streaming.score_stream import read_stream, score_stream


def test_restarted_stream_scores_every_record_once(spark, sample, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("inbox", "out", "mark"))

    def arrive(first, count):
        rows = spark.range(first, first + count).select(
            *[F.lit(sample[c]).cast(FEATURE_SCHEMA[c].dataType).alias(c) for c in FEATURES
              if c != "distance_km"],
            F.col("id").cast("double").alias("distance_km"),
        )
        rows.write.mode("append").json(inbox)

    def run():
        records = read_stream(spark, inbox, FEATURE_SCHEMA)
        score = lambda df: df.withColumn(FOOTPRINT, F.col("distance_km") * 2)
        score_stream(records, score, out, mark).awaitTermination()
        return spark.read.parquet(out)

    arrive(0, 30)
    assert run().count() == 30
    arrive(30, 20)
    scored = run()
    assert scored.count() == 50 == scored.select("distance_km").distinct().count()
    assert scored.where(f"{FOOTPRINT} != distance_km * 2").count() == 0
