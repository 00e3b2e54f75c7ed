"""Streams run to their end, over several micro-batches, into a table."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logweave.plans import queries
from logweave.streaming import jobs


def test_an_unfinished_stream_raises(spark, tmp_path):
    spark.range(4).repartition(4).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def wait(frames):  # inside, so that workers get it by value
        import time

        for f in frames:
            time.sleep(3)
            yield f

    slow = s.mapInPandas(wait, "id long")
    with pytest.raises(TimeoutError):
        jobs.run_once(slow, "slow", str(tmp_path / "c"), timeout=timedelta(seconds=1))


def test_events_cross_batches_and_land_in_a_table(spark, tmp_path):
    e = spark.range(300).select(F.col("id").alias("event_id"), (F.lit(1_767_225_600) + F.col("id") * 7200).cast("timestamp").alias("ts"), F.lit("click").alias("event_type"), F.lit("{}").alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.stream_dedup(spark, str(tmp_path))
    assert sorted(r.event_id for r in got.collect()) == list(range(300))
    parts = {f.split("/")[-2] for f in got.inputFiles()}
    assert len(parts) >= queries.STREAM_PARTS
    assert queries.stream_windows(spark, str(tmp_path)).agg(F.sum("event_count")).first()[0] == 300
