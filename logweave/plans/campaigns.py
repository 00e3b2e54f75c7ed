"""Which activity windows belong to the same campaign: errors by user, in 5-minute windows linked within a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.links import anchor_chains, attack_queues
from logweave.operators.pinning import pin_table
from logweave.operators.windows import MICRO, window_entities
from logweave.plans.events import event_frames, mentions_long

DAY = 86_400.0


def user_windows(spark: SparkSession, sf_dir: str, only: str | None = "error") -> DataFrame:
    """(window_id, window_start, entity_type, value) of users only, of events of one type, or of all."""
    frames = event_frames(spark, sf_dir, only)
    return window_entities(frames, mentions_long(frames).where("role = 'actor'"), MICRO)


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(queue_id, windows, users, first_start, last_start), largest first."""
    seen = pin_table(user_windows(spark, sf_dir), "user_windows")
    queues = attack_queues(anchor_chains(seen, DAY))
    members = queues.select("queue_id", F.explode("window_ids").alias("window_id")).join(seen, "window_id")
    out = members.groupBy("queue_id").agg(F.countDistinct("window_id").alias("windows"), F.countDistinct("value").alias("users"), F.min("window_start").alias("first_start"), F.max("window_start").alias("last_start"))
    return out.orderBy(F.desc("windows"), "queue_id")
