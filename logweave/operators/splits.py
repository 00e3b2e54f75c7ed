"""Splits by source and audits for leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.numbering import dense_position
from logweave.operators.pinning import pin
from logweave.vocabulary import BLOCKED_SOURCES


def source_held_out(rows: DataFrame, held_out: str, source: str = "source_dataset", id_col: str = "record_id", share: float = 0.8) -> DataFrame:
    """Adds split: test for the held-out source; of each other, the first 80% by the id's hash, at least one, train and the rest validation.

    The hash rank of a source's rows is found by bins of the hash, so that a large source isn't sorted
    in one task. Raises if a row has no source or the held-out one isn't there.
    """
    if not held_out:
        raise ValueError("a held-out source is required")
    seen = rows.agg(F.count(F.when(F.coalesce(source, F.lit("")) == "", 1)).alias("without"), F.count(F.when(F.col(source) == held_out, 1)).alias("held")).first()
    if seen.without:
        raise ValueError(f"{seen.without} rows without {source}")
    if not seen.held:
        raise ValueError(f"held-out source not found: {held_out}")
    keyed = rows.withColumn("__h", F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), 256)).withColumn("__bin", F.substring("__h", 1, 3))
    bins = keyed.groupBy(source, "__bin").agg(F.count("*").alias("__k"))
    w = W.partitionBy(source)
    bins = pin(bins.select(source, "__bin", (F.sum("__k").over(w.orderBy("__bin")) - F.col("__k")).alias("__before"), F.sum("__k").over(w).alias("__n")))
    place = F.row_number().over(W.partitionBy(source, "__bin").orderBy("__h")) + F.col("__before")
    cut = F.when(F.col("__n") > 1, F.greatest(F.lit(1), F.floor(F.col("__n") * share))).otherwise(F.col("__n"))
    split = F.when(F.col(source) == held_out, "test").when(place <= cut, "train").otherwise("validation")
    return keyed.join(bins, [source, "__bin"]).withColumn("split", split).drop("__h", "__bin", "__before", "__n")


def half_split(rows: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Adds split: the first half by id, at least one row, train and the rest validation. Fails with fewer than two rows."""
    n = rows.count()
    if n < 2:
        raise ValueError("a split needs two rows at least")
    placed = dense_position(rows, [id_col], "__place")
    return placed.withColumn("split", F.when(F.col("__place") < max(1, n // 2), "train").otherwise("validation")).drop("__place")


def leakage_findings(rows: DataFrame, blocked: tuple[str, ...] = BLOCKED_SOURCES) -> DataFrame:
    """(finding, record_id, occurrences): repeated ids, sources or paths that only score, test rows whose label trained.

    `rows`: record_id, source_dataset, source_file, split, label_used_for_training. Repeats are counted,
    not listed one by one: n - 1 of an id's n rows are findings.
    """
    ids = rows.where(F.coalesce("record_id", F.lit("")) != "").groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    text = F.concat_ws("\n", F.lower("source_dataset"), F.lower("source_file"))
    access = F.lit(False)
    for b in blocked:
        access = access | text.contains(b)
    who = F.coalesce(F.nullif("record_id", F.lit("")), F.lower("source_dataset"))
    per = lambda df, name: df.groupBy(F.lit(name).alias("finding"), who.alias("record_id")).agg(F.count("*").alias("occurrences"))
    return (
        ids.select(F.lit("duplicate_record_id").alias("finding"), "record_id", (F.col("n") - 1).alias("occurrences"))
        .unionByName(per(rows.where(access), "target_access")).unionByName(per(rows.where((F.col("split") == "test") & F.col("label_used_for_training")), "test_label_training"))
    )


def audit_passed(findings: DataFrame) -> bool:
    return findings.isEmpty()


def hard_negatives(candidates: DataFrame, count: int, id_col: str = "record_id", seed: int = 0) -> DataFrame:
    """`count` rows, or all: those whose ids' SHA-256 with the seed is lowest. A top-k, so no sort of all rows."""
    return candidates.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256), id_col).limit(count)
