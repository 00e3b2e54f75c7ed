"""Registered queries of guards, frozen features, releases, seals and single expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.ids import canonical_json, configuration_hash, content_hash
from logweave.functions.timebuckets import epoch_buckets
from logweave.operators import entities, evaluate, features, fusion, governance, graph, links, sinks, windows
from logweave.operators.pinning import new_table_path, pin_table
from logweave.plans.campaigns import DAY, user_windows
from logweave.plans.events import event_frames, joined_text, table
from logweave.plans.queries import query
from logweave.vocabulary import SCHEMA_VERSION


@query
def json_payload_ids(spark: SparkSession, sf: str) -> DataFrame:
    """orders as map payloads: their JSON with keys in order, its hash, and the hash of a configuration of the same keys."""
    o = table(spark, sf, "orders").select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("key"), F.col("o_orderkey").cast("string")).alias("m"))
    j = sinks.payload_json(o, "m")
    return j.select("o_orderkey", "payload_json", content_hash(canonical_json(F.col("m"))).alias("source_hash"), configuration_hash(F.map_filter("m", lambda k, v: k != "key")).alias("config_hash"))


@query
def epoch_windows(spark: SparkSession, sf: str) -> DataFrame:
    micro, macro = epoch_buckets(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return table(spark, sf, "events").select("event_id", micro.alias("micro"), macro.alias("macro"))


@query
def rule_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose name holds a 7 are positive."""
    return evaluate.label_rule(table(spark, sf, "customer"), F.col("c_name"), "7").select("c_custkey", "label")


@query
def weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' lengths and labels as scores, fused by weights alone."""
    y = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"), (F.col("doc_id") % 10).alias("c"))
    return fusion.weighted_fusion(y, {"a": 0.5, "b": -0.25, "c": 1.0}).select("doc_id", F.round("score", 9).alias("score"))


@query
def rule_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers and suppliers as typed rows, with defaults for what they lack."""
    c = table(spark, sf, "customer").select(F.lit("c").alias("dataset_id"), F.col("c_name").alias("raw_value"), F.when(F.col("c_custkey") % 2 == 0, "user").alias("entity_type"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).alias("canonical_value"))
    return entities.rule_entities(c).select("raw_value", "entity_type", "canonical_value", "confidence", "resolution_method", "entity_id")


@query
def entity_event_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's mentions that have an id, as nodes of its graph: objects of odd events have none."""
    f = event_frames(spark, sf)
    known = lambda m: F.when((m["role"] == "actor") | (F.col("source_line") % 2 == 0), m["raw_value"])
    rows = f.withColumn("mentions", F.transform("entity_mentions", lambda m: F.struct(m["raw_value"].alias("raw_value"), m["role"].alias("role"), known(m).alias("entity_id"), F.when(m["role"] == "actor", "user").alias("entity_type"))))
    nodes = F.transform("node_records", lambda n: F.concat_ws("/", n["node_type"], n["node_id"]))
    return graph.entity_graphs(rows).select("record_id", F.array_join(nodes, ",").alias("nodes"))


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return event_frames(spark, sf).select("dataset_id", "record_id", "timestamp", "source_record_ref", "value")


@query
def frozen_features(spark: SparkSession, sf: str) -> DataFrame:
    """Rows frozen with their producers' hashes and version, checked, then as a model sees them: without what says where they are from."""
    frozen = features.check_version(features.frozen_export(_feature_rows(spark, sf), {"events": "given", "a": "b"}))
    seen = features.assert_unlabeled(features.model_features(frozen))
    text = F.array_join(F.transform(F.map_entries("producer_artifact_hashes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return frozen.select("record_id", text.alias("producers"), "schema_version", F.lit(",".join(seen.columns)).alias("model_columns"), F.round("value", 6).alias("value"))


@query
def unversioned_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_rows(spark, sf).withColumn("schema_version", F.when(F.col("record_id").cast("long") % 11 == 0, F.when(F.col("record_id").cast("long") % 2 == 0, "")).otherwise(SCHEMA_VERSION))
    return features.invalid_features(rows.drop("dataset_id").withColumn("dataset_id", F.lit("events")))


@query
def label_columns(spark: SparkSession, sf: str) -> DataFrame:
    """What must not be where a model reads: of columns, and of keys in maps, of which only one customer's holds a label."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("Label"), F.col("c_name").alias("name"), F.create_map(F.when(F.col("c_custkey") == 7, "Ground_Truth").otherwise("segment"), F.col("c_mktsegment")).alias("more"), F.create_map(F.lit("fine"), F.lit("x")).alias("other"))
    return spark.createDataFrame([(n,) for n in features.forbidden_columns(c, ("more", "other"))], "name string")


@query
def window_row_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return features.window_rows(event_frames(spark, sf))


@query
def window_evidence(spark: SparkSession, sf: str) -> DataFrame:
    w = windows.evidence(windows.aggregate_windows(event_frames(spark, sf), windows.MICRO))
    return w.select("window_id", "event_count", joined_text("actions").alias("actions"))


@query
def links_above(spark: SparkSession, sf: str) -> DataFrame:
    """Links of error windows within a day that score enough: a decay alone decides, as all else is equal."""
    seen = pin_table(user_windows(spark, sf), "user_windows")
    same = F.array(F.lit("error"))
    sides = seen.select("window_id").distinct().select("window_id", same.alias("actions"), same.alias("path_nodes"), F.array(F.lit(1.0)).alias("graph_embedding"))
    scored = links.default_link_score(links.link_evidence(links.window_links(seen, DAY), sides))
    return links.above(scored, 0.85).select("source_window", "target_window", F.round("score", 6).alias("score"))


# Releases


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """customers as datasets, their segments as tiers and one file each."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("dataset_id"), F.when(F.col("c_mktsegment") == "BUILDING", "target").otherwise(F.col("c_mktsegment")).alias("tier"), F.concat(F.lit("/data/"), "c_custkey").alias("local_path"))


@query
def release_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A strict release: no target tier, none of two excluded, with the hashes of the files that are there."""
    r = _registry(spark, sf)
    files = r.where("dataset_id % 3 = 0").select(F.col("local_path").alias("path"), F.sha2("dataset_id", 256).alias("sha256"))
    return governance.release_selection(r, files, "strict", ("1",), ("2",)).select("dataset_id", "tier", F.coalesce("local_sha256", F.lit("")).alias("local_sha256"))


@query
def release_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What a release lacks whose files are named after nations of the first three regions: two of its parts and the checkpoints."""
    n = table(spark, sf, "nation")
    names = F.element_at(F.array(*[F.lit(x) for x in governance.RELEASE_FILES]), (F.col("n_regionkey") % 3 + 1).cast("int"))
    return governance.missing_artifacts(n.select(F.concat(F.lit("/release/"), "n_name", F.lit("/"), names).alias("path")), checkpoints=governance.CHECKPOINTS)


@query
def sealed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """documents as prediction files, sealed under a complete release."""
    release = table(spark, sf, "nation").select(F.concat(F.lit("/release/"), F.element_at(F.array(*[F.lit(x) for x in governance.RELEASE_FILES]), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("path"))
    p = table(spark, sf, "documents").select(F.concat(F.lit("/p/"), "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return governance.seal(p, release, "r1")


@query
def file_audit(spark: SparkSession, sf: str) -> DataFrame:
    """documents as one file a source, hashed as files."""
    path = new_table_path(spark, "audit")
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("value"))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return governance.file_hashes(spark, path).select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "bytes", "sha256")


@query
def stage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of a chain of stages, one a month of orders: what a stage read is what the one before wrote, but for every fifth."""
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    at = F.to_date(F.concat("month", F.lit("-01")))
    name = lambda d: F.concat(F.lit("/m/"), F.date_format(d, "yyyy-MM"))
    wrote = lambda d: F.sha2(name(d), 256)
    m = months.select(F.col("month").alias("stage"), F.col("n").alias("input_count"), F.col("n").alias("output_count"), F.lit(0).cast("long").alias("rejected_count"), name(F.add_months(at, -1)).alias("input_path"), F.when(F.col("n") % 5 == 0, "other").otherwise(wrote(F.add_months(at, -1))).alias("input_sha256"), name(at).alias("output_path"), wrote(at).alias("output_sha256"))
    return governance.run_summary(m)
