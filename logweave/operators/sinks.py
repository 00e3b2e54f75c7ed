"""Writers: JSON lines, split outputs with quarantine, manifests and logs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.functions.ids import canonical_json
from logweave.vocabulary import SCHEMA_VERSION


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order, replacing what is there when the job commits."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_split(parses: DataFrame, root: str, mode: str = "overwrite") -> dict[str, int]:
    """Valid and quarantined rows of one parse, by folder, in one pass; their counts."""
    seen = Observation()
    counted = parses.observe(seen, F.count("*").alias("rows"), F.count_if("quarantined").alias("quarantined"))
    counted.write.mode(mode).partitionBy("quarantined").parquet(root)
    n = seen.get
    return {"rows": n["rows"], "valid": n["rows"] - n["quarantined"], "quarantined": n["quarantined"]}


COMMITS = "_commits"


def write_batch(outputs: dict[str, DataFrame], root: str, batch: int) -> dict[str, int]:
    """Several outputs of one batch as one: each in a folder of the batch's number under `root`, then a commit with their counts.

    A batch that is written again replaces itself, so whoever reads by `committed` sees each row once
    and no output without the others.
    """
    counts, spark = {}, None
    for name, df in outputs.items():
        seen, spark = Observation(), df.sparkSession
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        counts[name] = seen.get["rows"]
    rows = [(batch, name, n) for name, n in counts.items()]
    spark.createDataFrame(rows, "batch bigint, output string, rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/{batch}")
    return counts


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(batch, output, rows) of the committed batches."""
    return spark.read.schema("batch bigint, output string, rows bigint").parquet(f"{root}/{COMMITS}/*")


def committed(spark: SparkSession, root: str, output: str) -> DataFrame:
    """The rows of an output that committed batches wrote, with their batch."""
    done = commits(spark, root).where(F.col("output") == output).select(F.col("batch").alias("__batch"))
    rows = spark.read.parquet(f"{root}/{output}")
    return rows.join(done, F.col("batch") == F.col("__batch"), "left_semi")


def append_quarantine(parses: DataFrame, root: str, batch: int) -> int:
    """Adds a batch's quarantined rows to the output `quarantine` under `root`; their number. The same batch again replaces itself."""
    return write_batch({"quarantine": parses.where("quarantined")}, root, batch)["quarantine"]


def stage_manifest(spark: SparkSession, stage: str, inputs: dict[str, str], outputs: dict[str, str], input_count: int, output_count: int, rejected_count: int = 0, flags: dict[str, str] | None = None, code_version: str = "") -> DataFrame:
    """One row of provenance: counts, path -> hash of inputs and outputs, versions, flags."""
    now = datetime.now(UTC).isoformat()
    schema = "stage string, created_at string, schema_version string, code_version string, inputs map<string,string>, outputs map<string,string>, input_count bigint, output_count bigint, rejected_count bigint, flags map<string,string>"
    return spark.createDataFrame([(stage, now, SCHEMA_VERSION, code_version, inputs, outputs, input_count, output_count, rejected_count, flags or {})], schema)


def run_stage(df: DataFrame, stage: str, transform, output: str) -> DataFrame:
    """Writes transform(df) as Parquet and returns its manifest row, its counts taken on the way."""
    seen_in, seen_out = Observation(), Observation()
    out = transform(df.observe(seen_in, F.count("*").alias("n"))).observe(seen_out, F.count("*").alias("n"))
    out.write.mode("overwrite").parquet(output)
    n = seen_in.get["n"], seen_out.get["n"]
    return stage_manifest(df.sparkSession, stage, {}, {output: content_digest(df.sparkSession.read.parquet(output))}, *n, max(0, n[0] - n[1]))


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: count, and sums of two hashes."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.sum(F.hash(*df.columns).cast("decimal(38,0)"))).first()
    return "-".join(str(x) for x in row)


def append_operation(spark: SparkSession, path: str, operation: str, status: str, details: dict[str, str] | None = None) -> None:
    """Adds a row to an operation log, which is a folder of JSON lines."""
    row = [(datetime.now(UTC).isoformat(), operation, status, details or {})]
    spark.createDataFrame(row, "timestamp_utc string, operation string, status string, details map<string,string>").coalesce(1).write.mode("append").json(path)


def export_links(links: DataFrame, queues: DataFrame, values: DataFrame, root: str) -> None:
    """Window links, attack queues and suspicious values, each a folder of JSON lines under `root`."""
    for name, df in (("window_links", links), ("attack_queues", queues), ("suspicious_nodes", values)):
        write_jsonl(df, f"{root}/{name}")


def export_predictions(scored: DataFrame, path: str) -> None:
    write_jsonl(scored.select("record_id", "score"), path)


def payload_json(df: DataFrame, column: str) -> DataFrame:
    """Adds payload_json, a map column as JSON with keys in order."""
    return df.withColumn("payload_json", canonical_json(F.col(column)))
