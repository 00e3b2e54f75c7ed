"""The `events` table as typed security events: user as actor, event type as action, property k as object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """dataset_id, record_id, ts, timestamp, source_file, source_line, action_family, outcome, roles, entity_mentions, value; rows of one type if asked for."""
    e = table(spark, sf_dir, "events")
    if only:
        e = e.where(F.col("event_type") == only)
    k = F.get_json_object("props", "$.k")
    mention = lambda v, r: F.struct(v.alias("raw_value"), F.lit(r).alias("role"))
    mentions = F.filter(F.array(mention(F.col("user_id").cast("string"), "actor"), mention(k, "object")), lambda m: m["raw_value"].isNotNull())
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.lit("events").alias("dataset_id"), F.col("event_id").cast("string").alias("record_id"), ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("events").alias("source_file"),
        F.col("event_id").alias("source_line"), F.col("event_type").alias("action_family"), F.when(F.col("event_type") == "error", "failure").otherwise("unknown").alias("outcome"),
        F.map_from_entries(F.transform(mentions, lambda m: F.struct(m["role"], m["raw_value"]))).alias("roles"), mentions.alias("entity_mentions"), F.concat(F.lit("events:"), F.col("event_id")).alias("source_record_ref"), "value",
    )


def mentions_long(frames: DataFrame) -> DataFrame:
    """(record_id, raw_value, role)."""
    return frames.select("record_id", F.explode("entity_mentions").alias("m")).select("record_id", "m.raw_value", "m.role")


def joined_text(values: Column | str) -> Column:
    return F.array_join(values, ",")
