"""Message templates: a catalog by exact mask, and merging of similar ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import mask, squeezed, template_fingerprint
from logweave.operators.pinning import pin_table
from logweave.operators.template_miner import Bucket, bucket_of, in_order

CACHE_VERSION = "templates-1"


def masked(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds template (the masked text) and fingerprint."""
    return messages.withColumn("template", mask(F.coalesce(text, F.lit("")))).withColumn("fingerprint", template_fingerprint(F.col("template")))


def catalog(templates: DataFrame) -> DataFrame:
    """(fingerprint, template, size): one row a template, the smallest of its spellings."""
    return templates.groupBy("fingerprint").agg(F.min("template").alias("template"), F.count("*").alias("size"))


def save_catalog(found: DataFrame, path: str, version: str = CACHE_VERSION) -> None:
    found.withColumn("cache_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_catalog(spark, path: str, version: str = CACHE_VERSION) -> DataFrame:
    """A saved catalog; a row of another version fails the read."""
    checked = F.when(F.col("cache_version") == version, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("cache version "), F.coalesce("cache_version", F.lit("null")))).cast("boolean"))
    return spark.read.parquet(path).where(checked).drop("cache_version")


def merge_similar(found: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds cluster (the first member's fingerprint) and cluster_template (differing words as <*>) to a catalog.

    Templates can only merge with others of as many words and the same first one, and join the first
    cluster, in order of size, that has at least `threshold` of its words in place. However many
    templates a bucket has, they flow by in order and only its clusters are held.
    """
    keyed = found.select("fingerprint", "template", "size", squeezed(F.col("template")).alias("words")).withColumns({"bucket": bucket_of(F.split("words", " ")), "less": -F.col("size")})

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, bucket, first = None, Bucket(threshold), []
        last = lambda: ((now, n, None, None, None, first[n], " ".join(w)) for n, (w, _) in bucket.clusters.items())
        for key, fingerprint, template, size, words in rows:
            if key != now:
                yield from last()
                now, bucket, first = key, Bucket(threshold), []
            n, change = bucket.add(words.split(" "), size)
            if change == "created":
                first.append(fingerprint)
            yield key, n, fingerprint, template, size, None, None
        yield from last()

    schema = "bucket string, n bigint, fingerprint string, template string, size bigint, cluster string, cluster_template string"
    rows = pin_table(in_order(keyed, ["less", "fingerprint"], ["bucket", "fingerprint", "template", "size", "words"], run, schema), "merged_templates")
    clusters = rows.where("cluster is not null").select("bucket", "n", "cluster", "cluster_template")
    return rows.where("fingerprint is not null").select("bucket", "n", "fingerprint", "template", "size").join(clusters, ["bucket", "n"]).drop("bucket", "n")
