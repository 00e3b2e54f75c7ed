"""Raw records to parses: ids, template, quarantine, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.ids import canonical_json, record_id, short_hash
from logweave.functions.text import is_blank


def parse(raw: DataFrame) -> DataFrame:
    """One row a raw record: record_id (its own, or derived), fields, template_text and its id, quarantine and confidence. No row is dropped."""
    fields = F.coalesce("payload_map", F.create_map(F.lit("message"), F.coalesce("payload_text", F.lit(""))))
    template = F.coalesce(canonical_json(F.col("payload_map")), "payload_text", F.lit(""))
    own = F.coalesce(F.nullif(F.col("raw_record_id"), F.lit("")), record_id("dataset_id", "source_file", "source_line"))
    out = raw.select("dataset_id", own.alias("record_id"), "source_file", "source_line", F.col("raw_timestamp").alias("timestamp"), F.when(F.col("payload_map").isNotNull(), "json").otherwise("text").alias("format"), fields.alias("fields"), template.alias("template_text"))
    out = out.withColumn("template_id", short_hash(F.col("template_text"))).withColumn("quarantine_reason", quarantine_reason(F.col("timestamp"), F.col("template_text")))
    out = out.withColumn("quarantined", F.col("quarantine_reason").isNotNull()).withColumn("parse_confidence", F.when(F.col("quarantined"), 0.0).otherwise(1.0))
    return out.withColumn("source_record_ref", F.concat_ws(":", "source_file", "source_line"))


def quarantine_reason(timestamp: Column, text: Column) -> Column:
    """missing_timestamp before empty_payload; null if neither."""
    return F.when(timestamp.isNull() | (timestamp == ""), "missing_timestamp").when(is_blank(text), "empty_payload")


def split_quarantine(parses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined)."""
    return parses.where(~F.col("quarantined")), parses.where("quarantined")


def first_by_content(raw: DataFrame, scope: str = "source_file", content: str = "source_hash", order: str = "source_line") -> DataFrame:
    """The first record of each content in its scope, and `copies`, how many it stands for.

    An aggregate of small structs finds it, so that a content with many copies is combined before the
    shuffle; then the rows are picked by a semi-join.
    """
    firsts = raw.groupBy(scope, content).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return raw.join(firsts, [scope, content, order]).dropDuplicates([scope, content, order])


def duplicate_counts(raw: DataFrame, scope: str = "source_file", content: str = "source_hash") -> DataFrame:
    """(scope, rows, duplicates)."""
    per = raw.groupBy(scope, content).agg(F.count("*").alias("n"))
    return per.groupBy(scope).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def event_order(dataset: str = "dataset_id") -> list[Column]:
    """The total order of events in a dataset."""
    return [F.coalesce("timestamp", F.lit("")), F.col("source_file"), F.col("source_line"), F.col("record_id")]


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, through a window that keeps one row a key before it shuffles."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
