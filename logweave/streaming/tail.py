"""Following text logs as they grow, with the line numbers and record ids that a batch reader gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.functions.text import is_blank
from logweave.operators.pinning import pin
from logweave.operators.sinks import committed, write_batch
from logweave.sources import line_source
from logweave.sources.raw import raw_records

RECORDS = "records"
COUNTS = "line_counts"


def tail_records(spark: SparkSession, path: str, root: str, checkpoint: str, dataset_id: str = "loghub_2_0", split_bytes: int = line_source.SPLIT_BYTES) -> DataStreamWriter:
    """A writer of raw records of the non-blank lines under `path`, as they are finished, to the output `records` under `root`; read them by tailed_records.

    Beside a batch's records goes how many lines each file has had so far, a row for each file: the
    next batch numbers on from there, with all its ranges at once. Both are one commit, and a batch that is run
    again starts from the counts before it, so it gives the same records. Triggered once or with what is available, a run
    is one batch; after a failure that is the one which failed.
    """
    line_source.register(spark)
    lines = spark.readStream.format(line_source.NAME).option("split_bytes", split_bytes).load(path)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema("source_file string, lines bigint").parquet(f"{root}/{COUNTS}/batch={number - 1}") if number else session.createDataFrame([], "source_file string, lines bigint")
        batch.persist()
        try:
            ranges = pin(line_source.counted_ranges(batch))
            numbered = line_source.numbered_ranges(batch, ranges, before).where(~is_blank(F.col("value")))
            now = before.unionByName(ranges.select("source_file", F.col("n").alias("lines"))).groupBy("source_file").agg(F.sum("lines").alias("lines"))
            write_batch({RECORDS: raw_records(numbered, dataset_id, "loghub_text_v1", text=F.col("value")), COUNTS: now}, root, number)
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tailed_records(spark: SparkSession, root: str) -> DataFrame:
    """The raw records of all committed batches."""
    return committed(spark, root, RECORDS).drop("batch")
