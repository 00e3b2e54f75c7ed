"""Micro and macro windows over event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ids import window_id
from logweave.functions.scores import sigmoid
from logweave.functions.text import WHOLE_IP
from logweave.functions.timebuckets import clock_bucket, clock_bucket_end

MICRO, MACRO = 5, 30


def window_entity_type(raw: Column, role: Column) -> Column:
    """Like an entity's type by role, but paths without a role stay unknown."""
    return (
        F.when(F.regexp_like(raw, F.lit(WHOLE_IP)), "ip").when(role == "actor", "user").when(role == "destination_host", "host")
        .when(role == "process", "process").when(role == "object", "file").otherwise("unknown")
    )


def with_window(events: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """Adds window_start and window_id. An event without a time fails the job."""
    need = F.when(F.col(ts).isNotNull(), F.col(ts)).otherwise(F.raise_error(F.lit("event without a time")).cast("timestamp"))
    out = events.withColumn("window_start", clock_bucket(need, minutes))
    return out.withColumn("window_id", window_id("dataset_id", minutes, F.col("window_start")))


def aggregate_windows(events: DataFrame, minutes: int, ts: str = "ts", action: str = "action_family", score: str | None = None) -> DataFrame:
    """(dataset_id, window_id, window_start, window_end, event_count, actions, suspicious_score).

    Counts, sets of actions and means combine before the shuffle. What grows with a window's events,
    its ids and entities, is in tables of its own: window_events, window_entities, window_vectors.
    """
    rows = with_window(events, minutes, ts)
    mean = F.avg(sigmoid(F.col(score).cast("double"))) if score else F.lit(None).cast("double")
    out = rows.groupBy("dataset_id", "window_id", "window_start").agg(F.count("*").alias("event_count"), F.sort_array(F.collect_set(action)).alias("actions"), mean.alias("suspicious_score"))
    return out.withColumn("window_end", clock_bucket_end(F.col("window_start"), minutes))


def window_events(events: DataFrame, minutes: int, ts: str = "ts", id_col: str = "record_id") -> DataFrame:
    """(window_id, event_id): which events a window has, as rows."""
    return with_window(events, minutes, ts).select("window_id", F.col(id_col).alias("event_id"))


def window_entities(events: DataFrame, mentions: DataFrame, minutes: int, ts: str = "ts") -> DataFrame:
    """(window_id, window_start, entity_type, value): distinct entities of each window. `mentions`: record_id, raw_value, role."""
    rows = with_window(events, minutes, ts).select("window_id", "window_start", "record_id")
    typed = mentions.select("record_id", window_entity_type(F.col("raw_value"), F.col("role")).alias("entity_type"), F.col("raw_value").alias("value"))
    return rows.join(typed, "record_id").select("window_id", "window_start", "entity_type", "value").distinct()


def window_vectors(events: DataFrame, vectors: DataFrame, minutes: int, dim: int, ts: str = "ts") -> DataFrame:
    """(window_id, embedding): mean of the events' vectors (record_id, vector), cut or filled with zeros to `dim`."""
    rows = with_window(events, minutes, ts).select("window_id", "record_id").join(vectors, "record_id")
    at = rows.select("window_id", F.posexplode(F.slice("vector", 1, dim)).alias("p", "x")).groupBy("window_id", "p").agg(F.avg("x").alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0.0)))
    return at.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "m"))).alias("by")).select("window_id", filled.alias("embedding"))


def window_table(events: DataFrame, mentions: DataFrame, minutes: int, ts: str = "ts", score: str | None = None, vectors: DataFrame | None = None, dim: int = 32) -> DataFrame:
    """One wide row a window, with event_ids and the map of entities: for export and small runs."""
    base = aggregate_windows(events, minutes, ts, score=score)
    ids = window_events(events, minutes, ts).groupBy("window_id").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    by_type = window_entities(events, mentions, minutes, ts).groupBy("window_id", "entity_type").agg(F.sort_array(F.collect_set("value")).alias("values"))
    maps = by_type.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "values"))).alias("entities"))
    out = base.join(ids, "window_id").join(maps, "window_id", "left")
    return out.join(window_vectors(events, vectors, minutes, dim, ts), "window_id", "left") if vectors is not None else out


def evidence(windows: DataFrame) -> DataFrame:
    return windows.select("window_id", "event_count", "actions")
