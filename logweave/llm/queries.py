"""The operators' registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import oracle, oracle_urls
from logweave.llm.cap_filters import vector_groups
from logweave.llm.license_scan import license_scan
from logweave.llm.line_dedup import line_dedup
from logweave.llm.mixing import mix_sources
from logweave.llm.packing import pack_documents
from logweave.llm.phrases import collocations
from logweave.llm.quality_rules import quality_rules
from logweave.llm.sharding import QUERY_LIMIT, shard_documents
from logweave.llm.simhash import simhash_groups
from logweave.llm.site_quality import site_quality
from logweave.llm.token_counts import token_counts
from logweave.llm.url_filter import filter_urls
from logweave.llm.word_runs import periodic_runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op2_spherical_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), QUERY_LIMIT)


def op8_line_runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), planted=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash_bktree, op2_spherical_cap_filters, op3_license_scan, op4_line_first_quality, op5_token_counts)
    ops += (op6_site_quality, op7_extendible_shards, op8_line_runs_dedup, op9_pareto_mix, op10_best_fit_packing)
    ops += (op11_periodic_runs, op12_phrase_collocations, op13_url_filter)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_first_quality": oracle.OP4, "op7_extendible_shards": oracle.OP7, "op8_line_runs_dedup": oracle.OP8, "op9_pareto_mix": oracle.OP9, "op12_phrase_collocations": oracle.OP12, "op13_url_filter": oracle_urls.OP13}
