"""Streams of log records: reading, dedup, windows, memory of entities, live links, template counts.

Stateless steps are the batch operators. State is bounded by a watermark or a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from logweave.functions.ids import content_hash, short_hash
from logweave.functions.text import is_blank, leading_timestamp, mask, timestamp_of_event
from logweave.functions.scores import sigmoid
from logweave.operators.campaign_store import CampaignStore
from logweave.operators.parse import quarantine_reason
from logweave.operators.pinning import new_table_path
from logweave.operators.sinks import write_batch


def tail_text(spark: SparkSession, path: str, dataset_id: str, leading: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """Records from text files as they appear. A record's identity is its file and content, as a stream has no line numbers."""
    source = spark.readStream.format("text")
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    lines = source.load(path).select(F.col("_metadata.file_path").alias("source_file"), "value").where(~is_blank(F.col("value")))
    time, rest = leading_timestamp(F.col("value")) if leading else (timestamp_of_event(F.col("value")), F.col("value"))
    out = lines.select(F.lit(dataset_id).alias("dataset_id"), "source_file", time.alias("timestamp"), rest.alias("message"), content_hash(F.col("value")).alias("source_hash"))
    out = out.withColumn("record_id", F.sha2(F.concat_ws("|", "dataset_id", "source_file", "source_hash").cast("binary"), 256))
    out = out.withColumn("quarantine_reason", quarantine_reason(F.col("timestamp"), F.col("message")))
    return out.withColumn("ts", F.try_to_timestamp("timestamp"))


def exactly_once(records: DataFrame, delay: str = "1 hour", ts: str = "ts", key: str = "source_hash") -> DataFrame:
    """The first record of each content within the delay."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, minutes: int, delay: str = "10 minutes", ts: str = "ts", action: str = "event_type", score: str | None = None) -> DataFrame:
    """(window_start, window_end, event_count, actions, suspicious_score) of tumbling windows; rows later than the delay are dropped."""
    mean = F.avg(sigmoid(F.col(score).cast("double"))) if score else F.lit(None).cast("double")
    w = events.withWatermark(ts, delay).groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("event_count"), F.sort_array(F.collect_set(action)).alias("actions"), mean.alias("suspicious_score"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count", "actions", "suspicious_score")


def session_counts(events: DataFrame, by: str, gap: str = "30 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(by, session_start, session_end, event_count): runs of a key's events without a longer gap."""
    w = events.withWatermark(ts, delay).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("event_count"))
    return w.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")


def live_links(window_entities: DataFrame, max_gap_seconds: float = 86_400.0, delay: str = "1 hour") -> DataFrame:
    """(entity_type, value, source_window, target_window, delta_seconds): links of windows that share an anchor within the gap, as they arrive.

    `window_entities`: window_id, window_start, entity_type, value, a stream. It is joined with itself by
    anchor and time, so a window is held until the gap and the delay have passed in event time, and no longer. Windows
    that come later than the delay are dropped, which the query's progress counts; repeated ones within it link once. Addresses link nothing and are left out.
    """
    seen = window_entities.where(F.col("entity_type").isin("user", "process", "host")).withWatermark("window_start", delay).dropDuplicatesWithinWatermark(["window_id", "entity_type", "value"])
    a = seen.select("entity_type", "value", F.col("window_id").alias("source_window"), F.col("window_start").alias("source_start"))
    b = seen.select(F.col("entity_type").alias("target_type"), F.col("value").alias("target_value"), F.col("window_id").alias("target_window"), F.col("window_start").alias("target_start"))
    same = (F.col("entity_type") == F.col("target_type")) & (F.col("value") == F.col("target_value"))
    gap = F.make_dt_interval(secs=F.lit(float(max_gap_seconds)))
    near = (F.col("target_start") >= F.col("source_start")) & (F.col("target_start") <= F.col("source_start") + gap)
    after = (F.col("target_start") > F.col("source_start")) | (F.col("target_window") > F.col("source_window"))
    delta = F.col("target_start").cast("double") - F.col("source_start").cast("double")
    return a.join(b, same & near & after).select("entity_type", "value", "source_window", "target_window", delta.alias("delta_seconds"))


class _EntitySpan(StatefulProcessor):
    """First and last time and count of an entity, for a time to live."""

    def __init__(self, keep_hours: float):
        self.keep = int(keep_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "first bigint, last bigint, n bigint", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = pd.concat([pd.to_datetime(r["ts"]).astype("datetime64[us]").astype("int64") for r in rows])
        least, most = int(times.min()), int(times.max())
        first, last, n = self.span.get() if self.span.exists() else (least, most, 0)
        first, last, n = min(first, least), max(last, most), n + len(times)
        self.span.update((first, last, n))
        yield pd.DataFrame([(key[0], key[1], pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n)], columns=["entity_type", "value", "first_seen", "last_seen", "mentions"])

    def close(self) -> None:
        pass


def entity_spans(mentions: DataFrame, keep_hours: float = 0.0) -> DataFrame:
    """(entity_type, value, first_seen, last_seen, mentions), updated with each batch. `mentions`: entity_type, value, ts.

    Kept for good, spans are sums that combine before the shuffle; with `keep_hours` an entity is forgotten that long after its last batch.
    """
    by, ts = mentions.groupBy("entity_type", "value"), F.col("ts").cast("timestamp")
    if not keep_hours:
        return by.agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("mentions"))
    return by.transformWithStateInPandas(_EntitySpan(keep_hours), "entity_type string, value string, first_seen timestamp, last_seen timestamp, mentions bigint", "Update", "ProcessingTime")


def template_counts(records: DataFrame, text: str = "message") -> DataFrame:
    """(bucket, template_id, template, size), a running count: buckets are word count and first word of the masked text."""
    template = mask(F.coalesce(text, F.lit("")))
    words = F.split(template, " ")
    return records.select(F.concat_ws("|", F.size(words), F.get(words, F.lit(0))).alias("bucket"), short_hash(template).alias("template_id"), template.alias("template")).groupBy("bucket", "template_id", "template").agg(F.count("*").alias("size"))


def with_quarantine(records: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """A writer that sends records with a quarantine reason to the output `quarantine` under `root` and the others to `valid`, see sinks.committed.

    Each batch is computed once, and a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_batch({"valid": batch.where("quarantine_reason is null"), "quarantine": batch.where("quarantine_reason is not null")}, root, number)
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", timeout: timedelta | None = None) -> DataFrame:
    """All that the source has now, through the stream to its end, as a Parquet table in the shared folder.

    The table holds what the run from a new `checkpoint` puts out: in complete mode the last batch, else
    the rows of all batches. A repeated batch replaces itself. A run that isn't finished after `timeout` is
    stopped and raises TimeoutError; without one there is no limit.
    """
    spark, path, batches = stream.sparkSession, new_table_path(stream.sparkSession, name), {}

    def write(batch: DataFrame, number: int) -> None:
        batches[number] = f"{path}/{number}"
        batch.write.mode("overwrite").parquet(batches[number])

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(max(1, int(timeout.total_seconds()))):
        query.stop()
        raise TimeoutError(f"stream {name} isn't finished after {timeout}")
    if not batches:
        return spark.createDataFrame([], stream.schema)
    paths = [batches[max(batches)]] if mode == "complete" else list(batches.values())
    return spark.read.schema(stream.schema).parquet(*paths)


def campaign_stream(window_entities: DataFrame, store: CampaignStore, checkpoint: str) -> DataStreamWriter:
    """A writer that adds each micro-batch of (window_id, window_start, entity_type, value) to a store of campaigns. A repeated batch changes nothing."""
    return window_entities.writeStream.foreachBatch(store.update).option("checkpointLocation", checkpoint)
