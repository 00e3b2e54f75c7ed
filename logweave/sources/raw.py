"""The record that every source gives, and numbering of physical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.ids import canonical_json, content_hash, record_id
from logweave.functions.text import is_blank
from logweave.operators.pinning import pin, pin_table

#: Columns of raw records, in order. A payload is text or a map, the other is null.
RAW = ("dataset_id", "source_file", "source_line", "raw_timestamp", "payload_text", "payload_map", "format", "parser_version", "adapter_version", "raw_record_id", "source_hash")


def raw_records(rows: DataFrame, dataset_id: str, version: str, text: Column | None = None, fields: Column | None = None, timestamp: Column | None = None) -> DataFrame:
    """RAW from rows (source_file, source_line, …)."""
    text = F.lit(None).cast("string") if text is None else text
    fields = F.lit(None).cast("map<string,string>") if fields is None else fields
    out = rows.select(F.lit(dataset_id).alias("dataset_id"), "source_file", F.col("source_line").cast("long").alias("source_line"), (F.lit(None) if timestamp is None else timestamp).cast("string").alias("raw_timestamp"), text.alias("payload_text"), fields.alias("payload_map"))
    out = out.withColumn("format", F.when(F.col("payload_map").isNotNull(), "json").otherwise("text"))
    out = out.withColumns({"parser_version": F.lit(version), "adapter_version": F.lit(version), "raw_record_id": record_id("dataset_id", "source_file", "source_line")})
    return out.withColumn("source_hash", content_hash(F.coalesce(canonical_json(F.col("payload_map")), "payload_text"))).select(*RAW)


def numbered_lines(spark: SparkSession, path: str | list[str], whole_files: bool = False) -> DataFrame:
    """(source_file, source_line, value): every physical line of text files, numbered from 1 in its file, without CR or LF. LF, CR or both end a line.

    Files are split as Spark likes. Lines are counted by split and those counts summed along the
    file, so no file has to go through one task. `whole_files` reads each file in one piece, for many
    small ones. Bad UTF-8 is replaced.
    """
    if whole_files:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
        lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), "\r\n|\r|\n")
        return text.where("value <> ''").select("source_file", F.posexplode(lines).alias("at", "value")).select("source_file", (F.col("at") + 1).cast("long").alias("source_line"), "value")
    return numbered_rows(spark.read.text(path), "value")


def numbered_rows(read: DataFrame, *columns: Column | str) -> DataFrame:
    """(source_file, source_line, columns): the rows of files just read, numbered from 1 in their file's order.

    Rows of a split have consecutive ids; counts by split, summed along the file, say where each begins.
    """
    rows = pin_table(read.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__order"), *columns), "numbered_rows")
    first = rows.groupBy("source_file", "__block").agg(F.count("*").alias("__n"), F.min("__order").alias("__least"))
    before = F.sum("__n").over(W.partitionBy("source_file").orderBy("__block")) - F.col("__n")
    starts = pin(first.select("source_file", "__block", "__least", before.alias("__before")))
    at = (F.col("__order") - F.col("__least") + F.col("__before") + 1).cast("long").alias("source_line")
    return rows.join(starts, ["source_file", "__block"]).select("source_file", at, *[c for c in rows.columns if c != "source_file" and not c.startswith("__")])


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows in file and line order; all if limit is 0."""
    return rows.orderBy("source_file", "source_line").limit(limit) if limit else rows


def first_physical_lines(rows: DataFrame, limit: int, value: str = "value") -> DataFrame:
    """Non-blank lines as read with an early stop by physical number: up to and including the first non-blank line numbered `limit` or more."""
    rows = rows.where(~is_blank(F.col(value)))
    if not limit:
        return rows
    stop = rows.where(F.col("source_line") >= limit).groupBy("source_file").agg(F.min("source_line").alias("__stop"))
    return rows.join(stop, "source_file", "left").where(F.col("source_line") <= F.coalesce("__stop", "source_line")).drop("__stop")
