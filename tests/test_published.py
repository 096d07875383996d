"""Versions and cached results that appear at once, and a stream that scores every id once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayprint.constants import FOOTPRINT, LEVEL
from dayprint.operators import model_store, scoring
from dayprint.operators.scoring import ResultCache
from dayprint.sources.published import new_part, part_path, publish, published
from dayprint.streaming.score_stream import read_stream, running_counts, score_stream_once, scored_once


def test_parts_are_seen_when_published(spark, tmp_path):
    folder = str(tmp_path / "parts")
    assert published(spark, folder) == []
    first, second = new_part(), new_part()
    for part in (first, second):
        spark.range(3).write.parquet(part_path(folder, part))
    assert published(spark, folder) == []
    publish(spark, folder, second)
    assert published(spark, folder) == [second]
    publish(spark, folder, first)
    assert published(spark, folder) == [second, first]
    with pytest.raises(FileNotFoundError):
        publish(spark, folder, new_part())


def test_reader_gets_the_old_or_the_new_set(spark, tmp_path, monkeypatch):
    """Saving writes marks in several steps; a reader between any two sees one whole version."""
    folder, seen = str(tmp_path / "models"), []

    def save(spark, models, path, best=None):
        for name in ("a", "b"):
            spark.createDataFrame([(models["set"],)], "v string").write.parquet(f"{path}/{name}")
            if model_store.versions(spark, folder):
                now = model_store.version_path(spark, folder)
                seen.append({spark.read.parquet(f"{now}/{n}").first()[0] for n in ("a", "b")})

    monkeypatch.setattr(model_store, "save_models", save)
    old = model_store.publish_models(spark, {"set": "old"}, folder)
    held = model_store.version_path(spark, folder)
    model_store.publish_models(spark, {"set": "new"}, folder)
    assert seen == [{"old"}, {"old"}]
    assert spark.read.parquet(f"{model_store.version_path(spark, folder)}/a").first()[0] == "new"
    assert spark.read.parquet(f"{held}/b").first()[0] == "old"
    model_store.roll_back(spark, folder, old)
    assert model_store.version_path(spark, folder) == held
    with pytest.raises(ValueError, match="version"):
        model_store.version_path(spark, folder, "none")
    assert model_store.version_path(spark, str(tmp_path / "plain")) == str(tmp_path / "plain")


def frame(spark, values):
    return spark.createDataFrame([(i, v, "a") for i, v in enumerate(values)], "id long, x double, c string")


def test_second_batch_scores_unseen_inputs_only(spark, tmp_path):
    seen = []

    def scorer(rows):
        seen.append(sorted(r["x"] if r["x"] is not None else -1.0 for r in rows.select("x").collect()))
        return rows.withColumn("y", F.coalesce(F.col("x") * 2, F.lit(-7.0)))

    def scored(cache, values):
        rows, figures = cache.score(frame(spark, values), scorer)
        got = {r["id"]: r["y"] for r in rows.collect()}
        assert got == {i: -7.0 if v is None else v * 2 for i, v in enumerate(values)}
        return tuple(figures.first())

    cache = ResultCache(spark, str(tmp_path / "cache"), "v1", ["x", "c"])
    assert scored(cache, [1.0] * 30 + [2.0, None, 0.0, -0.0]) == (34, 4, 0, 4, 0.0)
    assert scored(cache, [2.0, 3.0, None] * 5) == (15, 3, 2, 1, 2 / 3)
    assert seen == [[-1.0, 0.0, 1.0, 2.0], [3.0]]
    assert len(published(spark, cache.folder)) == 2
    # nothing new: no part is written
    assert scored(ResultCache(spark, str(tmp_path / "cache"), "v1", ["x", "c"]), [1.0, 3.0]) == (2, 2, 2, 0, 1.0)
    assert len(published(spark, cache.folder)) == 2
    cache.compact()
    assert scored(cache, [1.0, 2.0, 3.0, 4.0]) == (4, 4, 3, 1, 0.75)
    # another version knows nothing
    assert scored(ResultCache(spark, str(tmp_path / "cache"), "v2", ["x", "c"]), [1.0]) == (1, 1, 0, 1, 0.0)
    assert scored(cache, []) == (0, 0, 0, 0, 0.0)


def test_inputs_scored_side_by_side_do_not_multiply_rows(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"), "v1", ["x", "c"])
    scorer = lambda rows: rows.withColumn("y", F.col("x") + 1)
    cache.score(frame(spark, [1.0, 2.0]), scorer)
    # the same outputs once more, as a second job would publish them
    cache._write(cache.entries(), new_part())
    rows, figures = cache.score(frame(spark, [1.0, 2.0, 2.0]), scorer)
    assert rows.count() == 3 and figures.first()["hits"] == 2


def test_failed_batch_leaves_nothing(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"), "v1", ["x", "c"])

    def broken(rows):
        return rows.withColumn("y", F.expr("double(raise_error('no'))"))

    with pytest.raises(Exception, match="no"):
        cache.score(frame(spark, [1.0]), broken)
    assert cache.entries() is None


def test_replayed_ids_are_scored_once(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)
    scored_ids = []

    def arrive(ids, days=0):
        rows = [(i, start + dt.timedelta(days=days), float(i)) for i in ids]
        spark.createDataFrame(rows, "id long, at timestamp, x double").coalesce(1).write.mode("append").parquet(inbox)

    def score(rows):
        scored_ids.extend(r["id"] for r in rows.collect())
        return rows.select("id", F.col("x").alias(FOOTPRINT), F.expr(f"if(x < 10, 'Low', 'High') as {LEVEL}"))

    def run():
        records = read_stream(spark, inbox, "id long, at timestamp, x double", "parquet")
        score_stream_once(records, score, out, "id", "at", "2 days").awaitTermination()
        return scored_once(spark, out, f"id long, {FOOTPRINT} double, {LEVEL} string")

    arrive([1, 2, 3, 3])
    assert sorted(r["id"] for r in run().collect()) == [1, 2, 3]
    arrive([2, 3, 4, 11], days=1)  # a replay after a restart
    assert sorted(r["id"] for r in run().collect()) == [1, 2, 3, 4, 11]
    arrive([20], days=30)
    run()
    arrive([5], days=0)  # later than the watermark
    arrive([21], days=30)
    assert sorted(r["id"] for r in run().collect()) == [1, 2, 3, 4, 11, 20, 21]
    assert sorted(scored_ids) == sorted(set(scored_ids))
    counts = running_counts(spark, out).groupBy(LEVEL).agg(F.max_by("total", "batch").alias("n"))
    assert {r[LEVEL]: r["n"] for r in counts.collect()} == {"Low": 4, "High": 3}
    by_batch = [r["total"] for r in running_counts(spark, out).where(f"{LEVEL} = 'Low'").orderBy("batch").collect()]
    assert by_batch[0] == 3 and by_batch == sorted(by_batch)
