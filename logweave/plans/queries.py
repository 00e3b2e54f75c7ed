"""The registered queries: each runs an operator over a whole table. Their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import scores, vectors
from logweave.functions.ids import content_hash, record_id
from logweave.operators import asof, entities, evaluate, features, frames, fusion, governance, graph, history, links, parse, splits, template_miner, templates, windows
from logweave.operators.pinning import new_table_path, pin, pin_table
from logweave.plans.campaigns import DAY, campaigns, user_windows
from logweave.plans.events import event_frames, joined_text, mentions_long, table
from logweave.sources.readers import read_any_text, read_text_log
from logweave.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents as raw records: one file a source, numbered by id; those with fewer than 40 characters lose their text, every seventh its time."""
    d = table(spark, sf, "documents")
    text = F.when(F.length("text") >= 40, F.col("text"))
    time = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("2026-01-01T00:00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit("Z")))
    out = d.select(F.lit("documents").alias("dataset_id"), F.col("source").alias("source_file"), F.col("doc_id").alias("source_line"), time.alias("raw_timestamp"), text.alias("payload_text"), F.lit(None).cast("map<string,string>").alias("payload_map"))
    return out.withColumns({"raw_record_id": record_id("dataset_id", "source_file", "source_line"), "source_hash": content_hash(F.coalesce("payload_text", F.lit("")))})


# Ids, ingest, quarantine, dedup


@query
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", record_id(F.lit("events"), F.col("event_type"), F.col("event_id")).alias("record_id"), content_hash(F.col("props")).alias("source_hash"))


@query
def text_source_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """documents written as text files, a file a task, and read back: how often each non-blank line is there, each time under an id of its own."""
    path = new_table_path(spark, "text_source")
    table(spark, sf, "documents").select(F.translate("text", "\r", " ").alias("value")).write.text(path, lineSep="\n")
    kept = read_text_log(spark, path)
    return kept.groupBy(F.sha2(F.col("payload_text").cast("binary"), 256).alias("line_sha256")).agg(F.count("*").alias("records"), F.countDistinct("raw_record_id").alias("record_ids"))


@query
def text_source_all_lines(spark: SparkSession, sf: str) -> DataFrame:
    """conversations' texts as one log, every second one with a time: lines by the time found in them, blank ones too, and files whose numbers have gaps."""
    path = new_table_path(spark, "text_lines")
    stated = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" at 2026-02-03T04:05:0"), (F.col("turn") % 10).cast("string"), F.lit(".25Z"))).otherwise("")
    table(spark, sf, "conversations").select(F.concat(F.translate("text", "\r", " "), stated).alias("value")).where("value is not null").write.text(path, lineSep="\n")
    lines = read_any_text(spark, path, "conversations")
    times = lines.groupBy(F.coalesce("raw_timestamp", F.lit("")).alias("time")).agg(F.count("*").alias("lines"))
    per = lines.groupBy("source_file").agg(F.count("*").alias("n"), F.max("source_line").alias("last"), F.min("source_line").alias("first"))
    gaps = F.sum(F.when((F.col("n") == F.col("last")) & (F.col("first") == 1), 0).otherwise(1)).cast("long")
    return times.unionByName(per.agg(F.lit("gaps").alias("time"), gaps.alias("lines")))


@query
def parse_documents(spark: SparkSession, sf: str) -> DataFrame:
    p = parse.parse(raw_documents(spark, sf))
    return p.select("record_id", "source_line", "format", "template_id", "quarantined", "quarantine_reason", "parse_confidence")


@query
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    p = parse.parse(raw_documents(spark, sf))
    return p.groupBy("source_file").agg(F.count_if(~F.col("quarantined")).alias("valid"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.col("quarantine_reason") == "missing_timestamp").alias("missing_timestamp"), F.count_if(F.col("quarantine_reason") == "empty_payload").alias("empty_payload"))


@query
def dedup_hash(spark: SparkSession, sf: str) -> DataFrame:
    return parse.first_by_content(raw_documents(spark, sf)).select("source_file", "source_line", "source_hash", "copies")


@query
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return parse.duplicate_counts(raw_documents(spark, sf))


# Templates


@query
def mask_templates(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(table(spark, sf, "documents"))
    return m.select("doc_id", F.sha2(F.col("template").cast("binary"), 256).alias("masked_sha256"), "fingerprint")


@query
def template_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = templates.catalog(templates.masked(table(spark, sf, "documents")))
    return c.select("fingerprint", "size", F.length("template").cast("long").alias("chars"))


@query
def template_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(table(spark, sf, "documents")).select(F.col("text").alias("gold"), F.col("template").alias("predicted"))
    return evaluate.template_metrics(m).select("rows", "grouping_accuracy", "template_f1")


@query
def template_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Short messages of conversations, masked, their catalog, and similar templates merged."""
    lines = table(spark, sf, "conversations").select(F.explode(F.split("text", "\n")).alias("text"))
    return templates.merge_similar(templates.catalog(templates.masked(lines))).select("fingerprint", "size", "cluster", F.sha2(F.col("cluster_template").cast("binary"), 256).alias("cluster_sha256"))


# Frames and mentions


@query
def event_frames_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("message"))
    f = frames.extract_frames(d, F.col("message"))
    role = lambda r: F.coalesce(F.col("roles")[r], F.lit("")).alias(r)
    return f.select("doc_id", "action_family", "action_leaf", "relation_type", "outcome", "semantic_confidence", role("actor"), role("destination_host"), role("process"), role("object"), role("destination_ip"), F.size("entity_mentions").cast("long").alias("n_mentions"))


@query
def keyword_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    f = frames.keyword_frames(c, F.col("text"))
    return f.select("conv_id", "turn", "action", "outcome", "actor", "object", "semantic_confidence")


@query
def mention_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("entities", frames.mentions_of(F.col("text")))
    return d.select("doc_id", F.size("entities").cast("long").alias("n"), F.array_join("entities", "\n").alias("mentions"), frames.actor_of(F.col("entities")).alias("actor"), frames.object_of(F.col("entities")).alias("object"))


@query
def taxonomy_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """nation and region as a taxonomy of customers: attributes join, a label doesn't."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    names = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    taxonomy = names.select(F.col("n_nationkey").cast("string").alias("template_id"), F.create_map(F.lit("region"), "r_name", F.lit("nation"), "n_name", F.lit("true_label"), F.lit("x")).alias("attributes"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("template_id"), F.create_map(F.lit("segment"), "c_mktsegment").alias("attributes"))
    out = frames.enrich(c, taxonomy)
    return out.select("c_custkey", F.col("attributes")["region"].alias("region"), F.col("attributes")["nation"].alias("nation"), F.col("attributes")["segment"].alias("segment"), F.size("attributes").cast("long").alias("n_attributes"))


@query
def defaulted_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_frames(spark, sf).select("dataset_id", "record_id", "timestamp", F.when(F.col("action_family") != "view", F.col("action_family")).alias("action_family"))
    return frames.default_frames(rows).select("record_id", "action_family", "outcome", "unknown_score", "semantic_version")


# Entities


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.mention_entities(event_frames(spark, sf))


@query
def entity_links(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf).select("event_id", "role", "entity_type", "canonical_value", "entity_id", "confidence")


@query
def entity_table(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entities_of(_mentions(spark, sf)).select("entity_id", "entity_type", "canonical_value", "first_seen", "last_seen", "mentions")


@query
def simple_entities(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), frames.mentions_of(F.col("text")).alias("entities"))
    return entities.resolve_values(d).select(F.col("record_id").alias("doc_id"), "entity_type", "canonical_value", "entity_id")


@query
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Users of events under the names that customers' table has for them."""
    rows = event_frames(spark, sf).select("record_id", F.array(F.col("roles")["actor"]).alias("entities"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("canonical_value"), F.lit("token").alias("entity_type"), F.col("c_name").alias("alias"))
    return entities.resolve_values(rows, known).select("record_id", "canonical_value", "entity_id")


@query
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return entities.event_summary(_mentions(spark, sf)).select("event_id", "entity_count", joined_text("entity_types").alias("entity_types"))


@query
def entity_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = event_frames(spark, sf).select(F.col("roles")["actor"].alias("entity_id"), F.col("source_line").alias("order"), "action_family")
    return entities.latest(e, "entity_id", "order")


@query
def entity_matches(spark: SparkSession, sf: str) -> DataFrame:
    return entities.matching_mentions(_mentions(spark, sf)).select("entity_type", "entity_id", "mentions", "events")


@query
def entity_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each mention beside the one before it in runs of a hundred events: users, objects and made-up addresses in turn, so of one scope or not, equal or not."""
    f = event_frames(spark, sf).withColumn("entity_mentions", F.array_append("entity_mentions", F.struct(F.concat(F.lit("10.0.0."), F.col("source_line") % 5).alias("raw_value"), F.lit("destination_ip").alias("role"))))
    m = entities.mention_entities(f).withColumn("number", F.col("event_id").cast("long"))
    kept = m.where(F.pmod("number", F.lit(3)) == F.when(F.col("role") == "actor", F.col("number") % 3).when(F.col("role") == "object", 1).otherwise(2))
    s = F.struct("dataset_id", "entity_type", "entity_id")
    w = W.partitionBy(F.floor(F.col("number") / 100)).orderBy(F.col("role") != "actor", "entity_type", "number")
    pairs = kept.select("event_id", "role", s.alias("r"), F.lag(s).over(w).alias("l")).where("l is not null")
    return entities.score_pairs(pairs).select("event_id", "role", "reason", "score")


# Graph


def _keyed_frames(spark: SparkSession, sf: str) -> DataFrame:
    return event_frames(spark, sf).select("record_id", F.col("action_family").alias("action"), "outcome", "timestamp", "source_line")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return entities.resolve_values(event_frames(spark, sf).select("record_id", F.map_values("roles").alias("entities")))


@query
def event_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = graph.weighted_graph(_keyed_frames(spark, sf), _resolved(spark, sf), ["source_line"])
    return edges.select("source", "target", "relation", "weight", "timestamp")


@query
def event_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = graph.weighted_graph(_keyed_frames(spark, sf), _resolved(spark, sf), ["source_line"])
    return nodes.select("node_id", "node_type", "value", F.coalesce("outcome", F.lit("")).alias("outcome"))


@query
def graph_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_bounds(_keyed_frames(spark, sf), ["source_line"]).select("window_id", "start_time", "end_time")


@query
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = event_frames(spark, sf)
    nodes, edges = graph.strict_graph(f, entities.links_of(entities.mention_entities(f)))
    return graph.graph_summary(nodes, edges).select("node_count", "edge_count", joined_text("relations").alias("relations"), "score")


@query
def per_event_graphs(spark: SparkSession, sf: str) -> DataFrame:
    g = graph.event_graphs(event_frames(spark, sf))
    nodes = F.transform("node_records", lambda n: F.concat_ws("/", n["node_type"], n["node_id"]))
    edges = F.transform("edge_records", lambda e: F.concat_ws("/", e["role"], e["source"], e["target"]))
    return g.select("record_id", F.array_join(nodes, ",").alias("nodes"), F.array_join(edges, ",").alias("edges"))


def _tensors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = event_frames(spark, sf)
    nodes, edges = graph.strict_graph(f, entities.links_of(entities.mention_entities(f)))
    return graph.tensor_tables(nodes, edges, 8)  # a strict graph has a node for both ends of each edge


@query
def graph_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf)[1].select("source_index", "target_index", "relation_id")


@query
def graph_tensor_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _tensors(spark, sf)[0].select("node_index", "node_id", "type_id", F.round(F.element_at("features", 1) * 255).cast("long").alias("first_byte"), F.round(F.element_at("features", 8) * 255).cast("long").alias("last_byte"))


@query
def neighbor_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as edges from part to supplier, embeddings by key: each supplier's mean in-neighbour, its first two components and the sum of all."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    m = graph.neighbor_mean(edges, e, vector="embedding")
    return m.select("node_id", F.round(F.element_at("mean", 1), 5).alias("m0"), F.round(F.element_at("mean", 2), 5).alias("m1"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query
def byte_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.byte_vector(vectors.serialized(F.col("roles")), 12)
    out = event_frames(spark, sf).select("record_id", v.alias("v"))
    return out.select("record_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) * 255).cast("long").alias("total"), F.round(F.element_at("v", 1) * 255).cast("long").alias("first"))


# History


@query
def causal_history(spark: SparkSession, sf: str) -> DataFrame:
    h = history.causal_history(event_frames(spark, sf).withColumn("actor", F.col("roles")["actor"]), ["dataset_id", "actor"], ["record_id"], last=16)
    last = F.try_element_at("history", F.lit(-1))["record_id"]
    return h.select("record_id", "history_size", F.size("history").cast("long").alias("kept"), last.alias("last_id"), F.get("history", F.lit(0))["record_id"].alias("first_id"))


@query
def recent_history(spark: SparkSession, sf: str) -> DataFrame:
    """Of each event its user's events of the day before it: how many, the first and the last."""
    h = history.history_within(event_frames(spark, sf).withColumn("actor", F.col("roles")["actor"]), ["dataset_id", "actor"], ["record_id"], 86_400.0)
    return h.select("record_id", "history_size", F.try_element_at("history", F.lit(-1))["record_id"].alias("last_id"), F.get("history", F.lit(0))["record_id"].alias("first_id"))


@query
def history_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of events with a leak planted in every hundredth: those are what the guard finds."""
    h = history.causal_history(event_frames(spark, sf).withColumn("actor", F.col("roles")["actor"]), ["dataset_id", "actor"], ["record_id"], last=4)
    bad = F.when(F.col("source_line") % 100 == 0, F.array_append("history", F.struct("record_id"))).otherwise(F.col("history"))
    nodes = F.array(F.struct(F.lit("event:none").alias("node_id")))
    edges = F.array(F.struct(F.lit("a").alias("source"), F.when(F.col("source_line") % 250 == 1, F.concat(F.lit("event:"), "record_id")).otherwise("b").alias("target")))
    return history.leaks(h.select("record_id", bad.alias("history"), nodes.alias("graph_nodes"), edges.alias("graph_edges")))


@query
def links_before(spark: SparkSession, sf: str) -> DataFrame:
    """What one event, of number 500, may know: earlier events, their links, and the same with only itself left out."""
    f = event_frames(spark, sf)
    before = pin(history.history_before(f, "500").select("dataset_id", "record_id"))
    seen = history.links_before(entities.links_of(entities.mention_entities(f)), before)
    others = history.all_but(f, "500").agg(F.count("*").alias("others"))
    return before.agg(F.count("*").alias("earlier")).join(seen.agg(F.count("*").alias("earlier_links")), F.lit(True)).join(others, F.lit(True))


# Windows and links


def _windows(spark: SparkSession, sf: str, minutes: int) -> DataFrame:
    w = windows.aggregate_windows(event_frames(spark, sf), minutes, score="value")
    return w.select("window_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "event_count", joined_text("actions").alias("actions"), F.round("suspicious_score", 6).alias("suspicious_score"))


@query
def micro_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, windows.MICRO)


@query
def macro_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, windows.MACRO)


@query
def window_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean embedding of each half hour's events that have one."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("record_id"), F.col("embedding").alias("vector"))
    w = windows.window_vectors(event_frames(spark, sf), v, windows.MACRO, 70)
    return w.select("window_id", F.posexplode("embedding").alias("position", "x")).select("window_id", "position", F.round("x", 5).alias("x"))


@query
def window_links(spark: SparkSession, sf: str) -> DataFrame:
    found = links.window_links(user_windows(spark, sf), DAY)
    return found.select("source_window", "target_window", joined_text("anchors").alias("anchors"), "anchor_strength", F.round("delta_seconds").cast("long").alias("delta_seconds"))


@query
def ip_only_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of errors with users as strong and objects as weak anchors: pairs within an hour, candidates and rejections."""
    f = event_frames(spark, sf, "error")
    m = mentions_long(f).withColumn("entity_type", F.when(F.col("role") == "actor", "user").otherwise("ip"))
    starts = windows.with_window(f, windows.MICRO).select("window_id", "window_start", "record_id")
    rows = starts.join(m, "record_id").select("window_id", "window_start", "entity_type", F.col("raw_value").alias("value")).distinct()
    p = links.window_pairs(pin_table(rows, "anchors"), 3600.0)
    return p.select("source_window", "target_window", joined_text("shared_strong_entities").alias("shared_strong"), joined_text("shared_ip_entities").alias("shared_ip"), "candidate", F.coalesce("rejected_reason", F.lit("")).alias("rejected_reason"))


@query
def attack_queues(spark: SparkSession, sf: str) -> DataFrame:
    q = links.attack_queues(links.anchor_chains(user_windows(spark, sf), DAY))
    return q.select("queue_id", F.size("window_ids").cast("long").alias("windows"), F.element_at("window_ids", 1).alias("first_window"), F.element_at("window_ids", -1).alias("last_window"))


@query
def campaign_queues(spark: SparkSession, sf: str) -> DataFrame:
    c = campaigns(spark, sf)
    return c.select("queue_id", "windows", "users", F.date_format("first_start", "yyyy-MM-dd HH:mm:ss").alias("first_start"), F.date_format("last_start", "yyyy-MM-dd HH:mm:ss").alias("last_start"))


@query
def link_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence and default score of links within an hour between users' windows of all events: actions, objects as path, rarity of users."""
    seen = pin_table(user_windows(spark, sf, None), "user_windows")
    f = event_frames(spark, sf)
    acts = windows.aggregate_windows(f, windows.MICRO).select("window_id", "actions")
    objects = windows.with_window(f, windows.MICRO).groupBy("window_id").agg(F.collect_set(F.col("roles")["object"]).alias("path_nodes"), F.array(F.count("*").cast("double"), F.sum("value")).alias("graph_embedding"))
    e = links.link_evidence(links.window_links(seen, 3600.0), acts.join(objects, "window_id"), links.entity_rarity(seen))
    cols = ("anchor_score", "stable_rarity", "action_compatibility", "path_coherence", "graph_cosine", "score")
    return links.default_link_score(e).select("source_window", "target_window", *[F.round(c, 6).alias(c) for c in cols])


@query
def entity_memory(spark: SparkSession, sf: str) -> DataFrame:
    m = links.entity_memory(user_windows(spark, sf, None))
    return m.select("entity_type", "value", F.size("windows").cast("long").alias("n"), joined_text("windows").alias("windows"))


@query
def entity_rarity(spark: SparkSession, sf: str) -> DataFrame:
    return links.entity_rarity(user_windows(spark, sf, None)).select("value", F.round("rarity", 9).alias("rarity"))


@query
def suspicious_values(spark: SparkSession, sf: str) -> DataFrame:
    return links.suspicious_values(user_windows(spark, sf, None))


@query
def pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each embedding with the one before it of its label, among each thousand ids, and a digest of the pair's features."""
    w = W.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.lag("embedding").over(w).alias("before"), F.lag("vec_id").over(w).alias("before_id")).where("before is not null")
    gap = (F.col("vec_id") - F.col("before_id")) * 600
    f = vectors.pair_features(F.col("before"), F.col("embedding"), scores.decays(gap), F.array(F.lit(1.0)))
    return e.select("vec_id", F.round(vectors.cosine(F.col("before"), F.col("embedding")), 6).alias("cosine"), F.size(f).cast("long").alias("n"), F.round(F.aggregate(f, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# Features, splits, audits


@query
def feature_join(spark: SparkSession, sf: str) -> DataFrame:
    f = event_frames(spark, sf).withColumns({"semantic_confidence": F.lit(0.9), "unknown_score": F.lit(0.1)})
    key = [F.col("dataset_id"), F.col("record_id")]
    out = f.select(*key, F.array(F.col("value")).alias("event_embedding"), F.log1p("value").alias("raw_event_logit"), F.lit(0.25).alias("slot_nll"))
    by = lambda m: links.scores_by_event(windows.aggregate_windows(f, m, score="value"), windows.window_events(f, m)).select(F.lit("events").alias("dataset_id"), F.col("event_id").alias("record_id"), "score")
    j = features.join_features(f, out, by(windows.MICRO), by(windows.MACRO), hashes={"events": "given"})
    return j.select("record_id", *[F.round(c, 6).alias(c) for c in ("raw_event_score", "micro_window_score", "macro_window_score", "long_horizon_score", "slot_nll")], F.round(F.element_at("graph_embedding", 1), 6).alias("graph_first"))


@query
def feature_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label or an embedding, by what they lack."""
    d = table(spark, sf, "documents").select(F.lit("d").alias("dataset_id"), F.col("doc_id").alias("record_id"))
    need = {"label": table(spark, sf, "labels").select(F.lit("d").alias("dataset_id"), F.col("doc_id").alias("record_id")), "embedding": table(spark, sf, "embeddings").select(F.lit("d").alias("dataset_id"), F.col("vec_id").alias("record_id"))}
    return features.missing_inputs(d, need).select("record_id", "missing")


@query
def source_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.source_held_out(table(spark, sf, "documents").select("doc_id", "source"), "src3", "source", "doc_id")


@query
def half_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.half_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """documents, and again those whose id ends in 0, in a split by id, with labels used in training for all but every ninth."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    rows = d.unionByName(d.where("doc_id % 10 = 0"))
    rows = rows.select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("source_dataset"), F.concat(F.lit("/data/"), "source").alias("source_file"), F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("doc_id") % 9 != 0).alias("label_used_for_training"))
    return splits.leakage_findings(rows, ("src1",))


@query
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred of the bad documents, by a seeded hash: a sampler, so the limit is the feature."""
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return splits.hard_negatives(bad, 100, "doc_id", 7)


# Metrics


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with logits made of documents' lengths."""
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    x = (F.col("n_chars") % 1000) / 500.0 - 1
    logits = {"event_logit": x, "micro_logit": x * 0.5, "macro_logit": x + 0.25, "fused_logit": x * 2 - 0.1}
    return y.join(d, "doc_id").select("doc_id", "source", F.col("quality").alias("label"), "toxic", *[v.alias(k) for k, v in logits.items()])


@query
def threshold_fit(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fit_threshold(_scored(spark, sf), "documents", "fused_logit").select(F.round("threshold", 9).alias("threshold"))


@query
def calibration_fit(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fit_calibration(_scored(spark, sf), "documents", "fused_logit", exact=True, by=["source"]).select("source", "temperature", F.round("threshold", 9).alias("threshold"))


@query
def score_eval(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, 0.2).otherwise(0.8).alias("score"))
    return evaluate.score_labels(s, table(spark, sf, "labels"), "doc_id", "score", "quality")


@query
def loss_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.loss_metrics(_scored(spark, sf))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query
def ranking_loss(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluate.pairwise_ranking(_scored(spark, sf), batch="source")
    return r.select("batch", F.round("ranking", 6).alias("ranking"))


@query
def vector_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Over embeddings as logits: likelihood of the label's slot, every tenth ignored, an inverse margin, and contrast with the neighbour."""
    e = table(spark, sf, "embeddings").withColumn("target", F.when(F.col("vec_id") % 10 == 0, -100).otherwise(F.col("label")))
    nll = evaluate.mean_slot_nll(e, "embedding")
    margin = evaluate.inverse_margin(e, [(0, 1), (2, 3)], "embedding")
    pairs = e.withColumn("next", F.lead("embedding").over(W.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id"))).where("next is not null")
    contrast = evaluate.cosine_contrast(pairs, "embedding", "next")
    both = nll.join(margin, F.lit(True)).join(contrast, F.lit(True))
    return both.select(*[F.round(c, 5).alias(c) for c in ("slot_nll", "margin", "contrast")])


@query
def mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Order values as batches of metrics: means by priority and status."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("value"))
    m = evaluate.mean_metrics(o, ["run"])
    return m.select("run", "metric", F.round("value", 4).alias("value"))


@query
def alert_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of toxic documents at budgets of alerts, by a score without ties."""
    s = _scored(spark, sf).select((F.col("fused_logit") * 1000 + F.col("doc_id") / 1e7).alias("score"), F.col("toxic").alias("label"), "doc_id")
    return evaluate.alert_curve(s, [10, 100, 1000], ties=["doc_id"]).select("budget", F.round("recall", 9).alias("recall"))


def _alerts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Errors as alerts, and signups as the attacks that they may tell of."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type")


@query
def detection_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Each signup with the time to its user's first error within a day and before the next signup."""
    d = asof.detection_delays(*_alerts(spark, sf), horizon_seconds=86_400.0, by=["user_id"])
    return d.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), F.round("delay_seconds", 4).alias("delay_seconds"))


@query
def false_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Errors that follow no signup of their user within an hour, in all and an hour."""
    r = asof.false_alert_rate(*_alerts(spark, sf), horizon_seconds=3600.0, by=["user_id"])
    return r.select("alerts", "false_alerts", F.round("per_hour", 6).alias("per_hour"))


@query
def link_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Links of windows within an hour by time alone, by any entity and by stable ones, with the share whose windows have a user's error in common."""
    f = event_frames(spark, sf)
    seen = pin_table(windows.window_entities(f, mentions_long(f), windows.MICRO), "window_entities")
    errors = event_frames(spark, sf, "error")
    truth = windows.with_window(errors, windows.MICRO).select("window_id", F.col("roles")["actor"].alias("label")).distinct()
    sets = {"time": links.time_adjacent_links(seen, 3600.0), "any": links.any_overlap_links(seen, 3600.0), "stable": links.window_links(seen, 3600.0)}
    return links.link_quality(sets, truth).select("links", "n_links", "n_right", F.round("precision", 9).alias("precision"))


@query
def fusion_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with labels of documents by id: four logistic heads and their fused score."""
    e, y = table(spark, sf, "embeddings"), table(spark, sf, "labels")
    rows = e.join(y, e["vec_id"] == y["doc_id"]).select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("event_embedding"), (F.col("label") / 10.0).alias("graph_score"), ((F.col("vec_id") % 7) / 7.0).alias("long_horizon_score"), F.col("quality").cast("double").alias("label"))
    rows = pin(rows)
    return fusion.apply_fusion(fusion.fit_fusion(rows), rows).select("record_id", "event_logit", "micro_logit", "macro_logit", "fused_logit", "score")


# Governance


@query
def state_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's event types as states that may only follow in a fixed order."""
    steps = (("view", "click"), ("click", "signup"), ("signup", "purchase"), ("purchase", "view"), ("view", "view"))
    bad = governance.illegal_transitions(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], steps, None)
    return bad.select("event_id", "user_id", "previous", F.col("event_type").alias("state"))


@query
def tamper_check(spark: SparkSession, sf: str) -> DataFrame:
    """documents sealed by hash, then some gone, some changed, and some that never were sealed."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/doc/"), "doc_id").alias("path"), "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    sealed = d.select(F.when(F.col("doc_id") % 97 == 0, "DRAFT").otherwise("PREDICTIONS_SEALED").alias("status"), "path", digest(F.col("text")).alias("sha256"))
    now = d.where("doc_id % 50 <> 3").select("path", digest(F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return governance.tampered(sealed, now)


@query
def registry_audit(spark: SparkSession, sf: str) -> DataFrame:
    """customers as a registry of datasets: segments as roles, some fields missing, some states wrong."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    entry = c.select(
        key.cast("string").alias("dataset_id"), F.when(key % 11 != 0, F.col("c_name")).alias("display_name"), F.when(key % 5 == 0, "target_test").otherwise("source").alias("role"), F.col("c_mktsegment").alias("tier"), F.lit("u").alias("official_url"),
        F.when(key % 13 == 0, "lost").otherwise("ready").alias("status"), F.when(key % 10 == 0, "evaluation_only_p1").otherwise("training").alias("allowed_label_usage"), F.lit("p").alias("prohibited_usage"),
    )
    return governance.registry_violations(entry)


# Sinks and streams


@query
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from logweave.operators.sinks import write_jsonl
    from logweave.sources.readers import read_jsonl

    path = new_table_path(spark, "jsonl")
    write_jsonl(table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars"), path)
    back = read_jsonl(spark, path, "doc_id bigint, source string, text string, n_chars bigint")
    return back.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n_chars")


STREAM_PARTS = 4


def event_stream(spark: SparkSession, sf: str, repeats: bool = False) -> DataFrame:
    """The events table as a stream of files: parts of equal size by time, a file each, written in order and read as one micro-batch each.

    Files are read in the order of their modification times, so no part is late. With `repeats`, a part
    also has two of three events of the part before once more. Events without a time are in the first part.
    """
    path = new_table_path(spark, "event_stream")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    bounds = e.agg(F.percentile_approx(at, [k / STREAM_PARTS for k in range(1, STREAM_PARTS)])).first()[0] or []
    part = sum((F.coalesce(at > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    for k in range(STREAM_PARTS):
        again = (part == k - 1) & (F.col("event_id") % 3 > 0)
        e.where((part == k) | again if repeats else part == k).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hour counts through a stream, in complete mode, so that all windows are out at its end."""
    w = jobs.window_counts(event_stream(spark, sf), windows.MACRO)
    out = jobs.run_once(w, f"stream_windows_{id(w)}", new_table_path(spark, "stream"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_count", joined_text("actions").alias("actions"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their repeats, in their own and the next micro-batch, through exactly-once dedup: each id once."""
    e = event_stream(spark, sf, repeats=True)
    twice = e.withColumn("copy", F.explode(F.sequence(F.lit(1), 1 + (F.col("event_id") % 3).cast("int"))))
    d = jobs.exactly_once(twice.withColumn("source_hash", F.sha2(F.col("event_id").cast("string"), 256)), "30 days")
    return jobs.run_once(d.select("event_id", "event_type"), f"stream_dedup_{id(d)}", new_table_path(spark, "stream"))


@query
def stream_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts of masked props through a stream."""
    t = jobs.template_counts(event_stream(spark, sf).withColumn("message", F.concat_ws(" ", "event_type", "props")))
    return jobs.run_once(t, f"stream_templates_{id(t)}", new_table_path(spark, "stream"), "complete").select("template", "size")


@query
def mined_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents mined in their order: each line's cluster, and its template as it was then."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "message"))
    found = template_miner.mine_templates(lines.withColumn("record_id", F.concat_ws("|", "doc_id", "at")), ["doc_id", "at"])
    return found.select("id", F.sha2(F.concat_ws("|", "bucket", "cluster", "template").cast("binary"), 256).alias("template_sha256"), "change", "size")


@query
def stream_mined_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Masked props of events mined as a stream of several batches, at most a hundred clusters remembered of each number of words and first word."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = event_stream(spark, sf).withColumn("message", F.concat_ws(" ", "event_type", F.regexp_replace("props", r"[:,]", " ")))
    m = template_miner.mine_stream(e, ["ts", "event_id"], id_col="event_id", max_clusters=100)
    return jobs.run_once(m, f"stream_mined_{id(m)}", new_table_path(spark, "stream")).select(F.col("id").cast("long").alias("event_id"), "template", "change", "size")


@query
def stream_live_links(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all events by user as a stream of several batches: links within an hour as they arrive, the same as from a table."""
    path, seen = new_table_path(spark, "window_stream"), pin_table(user_windows(spark, sf, None), "user_windows")
    at = F.unix_micros("window_start")
    bounds = seen.agg(F.percentile_approx(at, [k / STREAM_PARTS for k in range(1, STREAM_PARTS)])).first()[0] or []
    for k in range(STREAM_PARTS):
        seen.where(sum(((at > b).cast("int") for b in bounds), F.lit(0)) == k).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = jobs.live_links(s, max_gap_seconds=3600.0)
    out = jobs.run_once(found, f"stream_links_{id(found)}", new_table_path(spark, "stream"))
    return out.select("source_window", "target_window").distinct()
