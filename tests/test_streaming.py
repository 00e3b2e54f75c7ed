"""Streams give what tables give."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logweave.operators import sinks
from logweave.streaming import jobs


def test_tail_and_quarantine(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-01-01T00:00:00Z hello\n\nbad line\n2026-01-01T00:00:00Z hello\n")
    s = jobs.tail_text(spark, str(tmp_path / "in"), "d")
    q = jobs.with_quarantine(s, str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(sinks.committed(spark, str(tmp_path / "out"), "valid"), "message") == [("hello",), ("hello",)]
    assert rows(sinks.committed(spark, str(tmp_path / "out"), "quarantine"), "quarantine_reason") == [("missing_timestamp",)]
    assert rows(sinks.commits(spark, str(tmp_path / "out")), "output", "rows") == [("quarantine", 1), ("valid", 2)]
    once = jobs.run_once(jobs.exactly_once(s.where("ts is not null")), "once", str(tmp_path / "c2"))
    assert once.count() == 1


def stream(spark, df, path, parts=3, by="ts"):
    df.repartitionByRange(parts, by).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_and_sessions(spark, tmp_path, rows):
    df = spark.range(30).select((F.lit(1_767_225_600) + F.col("id") * 200).cast("timestamp").alias("ts"), (F.col("id") % 2).cast("string").alias("event_type"), F.lit(0.0).alias("s"))
    s = stream(spark, df, str(tmp_path / "in"))
    got = jobs.run_once(jobs.window_counts(s, 5, score="s"), "w", str(tmp_path / "c"), "complete")
    want = df.groupBy(F.window("ts", "5 minutes")).count()
    assert rows(got, "event_count") == rows(want, "count") and {r.suspicious_score for r in got.collect()} == {0.5}
    sess = jobs.run_once(jobs.session_counts(s, "event_type", delay="1 day"), "ses", str(tmp_path / "c2"), "complete")
    assert rows(sess, "event_type", "event_count") == [("0", 15), ("1", 15)]


def test_live_links_equal_batch(spark, tmp_path, rows):
    from logweave.operators.links import window_links

    w = spark.range(24).select(F.format_string("w%02d", "id").alias("window_id"), (F.lit(1_767_225_600) + F.col("id") * 3600).cast("timestamp").alias("window_start"), F.when(F.col("id") % 6 == 0, "ip").otherwise("user").alias("entity_type"), (F.col("id") % 4).cast("string").alias("value"))
    twice = w.unionByName(w.where("window_id = 'w07'"))
    s = stream(spark, twice, str(tmp_path / "in"), by="value")
    got = jobs.run_once(jobs.live_links(s, 6 * 3600.0, "3 days"), "links", str(tmp_path / "c"))
    assert rows(got, "source_window", "target_window", "delta_seconds") == rows(window_links(w, 6 * 3600.0), "source_window", "target_window", "delta_seconds")


def test_live_links_forget_what_is_past_the_gap_and_drop_late_windows(spark, tmp_path):
    schema = "window_id string, window_start timestamp, entity_type string, value string"
    for k in range(8):  # a batch each; the last holds a window that is far too late
        rows = [(f"w{k}-{i}", datetime(2026, 1, 1) + timedelta(hours=6 * k, minutes=i), "user", "u") for i in range(20)]
        rows += [("late", datetime(2026, 1, 1), "user", "u")] if k == 7 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    q = jobs.live_links(s, 3600.0, "10 minutes").writeStream.foreachBatch(lambda b, n: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    held = [max(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert len(found) == 8 * 190 and max(held) <= 80  # of 160 windows, a batch or two
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 2  # once on each side
    assert not any("late" in (r.source_window, r.target_window) for r in found)


def test_a_batch_cut_off_between_its_outputs_is_written_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-01-01T00:00:00Z one\nbad\n")
    out, write = str(tmp_path / "out"), sinks.write_batch

    def broken(outputs, root, batch):
        outputs["valid"].write.mode("overwrite").parquet(f"{root}/valid/batch={batch}")
        raise OSError("lost")

    run = lambda: jobs.with_quarantine(jobs.tail_text(spark, str(tmp_path / "in"), "d"), out, str(tmp_path / "c")).trigger(availableNow=True).start()
    monkeypatch.setattr(jobs, "write_batch", broken)
    with pytest.raises(StreamingQueryException):
        run().awaitTermination(120)
    monkeypatch.setattr(jobs, "write_batch", write)
    (tmp_path / "in" / "b.log").write_text("2026-01-01T00:00:00Z two\n")
    run().awaitTermination(120)
    assert sorted(r.message for r in sinks.committed(spark, out, "valid").collect()) == ["one", "two"]
    assert sinks.committed(spark, out, "quarantine").count() == 1
    assert {r.output: r.n for r in sinks.commits(spark, out).groupBy("output").agg(F.sum("rows").alias("n")).collect()} == {"valid": 2, "quarantine": 1}


def test_entity_spans_and_templates(spark, tmp_path, rows):
    m = spark.createDataFrame([("user", "a", 1), ("user", "a", 5), ("user", "b", 2)], "entity_type string, value string, n int").withColumn("ts", F.col("n").cast("timestamp"))
    got = jobs.run_once(jobs.entity_spans(stream(spark, m, str(tmp_path / "in"))), "spans", str(tmp_path / "c"), "update")
    last = got.groupBy("value").agg(F.max("mentions").alias("n"), F.min("first_seen").cast("long").alias("a"), F.max("last_seen").cast("long").alias("z"))
    assert rows(last) == [("a", 2, 1, 5), ("b", 1, 2, 2)]
    t = jobs.template_counts(stream(spark, m.withColumn("message", F.concat(F.lit("port "), "n")), str(tmp_path / "in2")))
    assert rows(jobs.run_once(t, "templates", str(tmp_path / "c3"), "complete"), "template", "size") == [("port <NUM>", 3)]


def test_spans_without_a_time_to_live_are_sums(spark, tmp_path):
    m = spark.createDataFrame([("user", "u", 0)], "entity_type string, value string, at long").select("entity_type", "value", F.timestamp_seconds("at").alias("ts"))
    spans = jobs.entity_spans(stream(spark, m, str(tmp_path / "in")))
    assert "TransformWithState" not in spans._jdf.queryExecution().logical().toString()
