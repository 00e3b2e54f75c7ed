"""Event-entity graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ids import iso_utc, node_id, short_hash
from logweave.functions.vectors import byte_vector
from logweave.operators.numbering import dense_position

# The edge that a mention's role makes.
EDGE_OF_ROLE = {"actor": "actor_of", "destination_host": "destination_of", "destination_ip": "destination_of", "process": "process_of", "object": "object_of"}


def edge_role(role: Column) -> Column:
    out = F.lit("session_of")
    for r, e in EDGE_OF_ROLE.items():
        out = F.when(role == r, e).otherwise(out)
    return out


def event_node(record: Column | str) -> Column:
    return F.concat(F.lit("event:"), F.col(record) if isinstance(record, str) else record)


def strict_graph(frames: DataFrame, links: DataFrame, typed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node for each event and linked entity, an edge for each link.

    Entity nodes are of type unknown, or of the type that `typed` (entity_id, entity_type) knows.
    """
    events = frames.select(event_node("record_id").alias("node_id"), F.lit("event").alias("node_type"), "action_family", "outcome").groupBy("node_id", "node_type").agg(F.max(F.struct("action_family", "outcome")).alias("a")).select("node_id", "node_type", "a.*")
    others = links.select(F.col("entity_id").alias("node_id")).distinct()
    kind = F.lit("unknown")
    if typed is not None:
        others, kind = others.join(typed.select(F.col("entity_id").alias("node_id"), "entity_type").dropDuplicates(["node_id"]), "node_id", "left"), F.coalesce("entity_type", F.lit("unknown"))
    others = others.select("node_id", kind.alias("node_type"), F.lit(None).cast("string").alias("action_family"), F.lit(None).cast("string").alias("outcome"))
    edges = links.select(F.col("entity_id").alias("source"), event_node("event_id").alias("target"), edge_role(F.col("role")).alias("role"), "confidence")
    return events.unionByName(others), edges


def weighted_graph(frames: DataFrame, entities: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with weights: entity participates in event, event has_action. `frames`: record_id, action, outcome, timestamp and the order's columns; `entities`: record_id, entity_id, entity_type, canonical_value.

    An edge's weight counts its occurrences, its timestamp is the last in order. Of an entity node the
    first attributes count, of an event node the last.
    """
    order_struct = F.struct(*order)
    action = node_id(F.lit("action"), F.col("action"))
    joined = entities.join(frames, "record_id")
    participates = joined.select(F.col("entity_id").alias("source"), event_node("record_id").alias("target"), F.lit("participates").alias("relation"), "timestamp", order_struct.alias("o"))
    has = frames.select(event_node("record_id").alias("source"), action.alias("target"), F.lit("has_action").alias("relation"), "timestamp", order_struct.alias("o"))
    edges = participates.unionByName(has).groupBy("source", "target", "relation").agg(F.count("*").cast("double").alias("weight"), F.max_by("timestamp", "o").alias("timestamp"))
    event_nodes = frames.groupBy(event_node("record_id").alias("node_id")).agg(F.lit("event").alias("node_type"), F.max_by("action", order_struct).alias("value"), F.max_by("outcome", order_struct).alias("outcome"))
    entity_nodes = joined.groupBy(F.col("entity_id").alias("node_id")).agg(F.min_by("entity_type", order_struct).alias("node_type"), F.min_by("canonical_value", order_struct).alias("value"), F.lit(None).cast("string").alias("outcome"))
    action_nodes = frames.groupBy(action.alias("node_id")).agg(F.lit("action").alias("node_type"), F.min("action").alias("value"), F.lit(None).cast("string").alias("outcome"))
    return event_nodes.unionByName(entity_nodes).unionByName(action_nodes), edges


def graph_bounds(frames: DataFrame, order: list[str]) -> DataFrame:
    """One row: first and last time, and the window id that hangs on the first time, else the first record, else on nothing."""
    row = frames.agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min_by("record_id", F.struct(*order)).alias("first_record"))
    anchor = F.coalesce(iso_utc(F.col("start_time").cast("timestamp")), "first_record", F.lit("empty"))
    return row.select(F.concat(F.lit("window:"), short_hash(anchor)).alias("window_id"), "start_time", "end_time")


def graph_summary(nodes: DataFrame, edges: DataFrame, relation: str = "role") -> DataFrame:
    """One row: node_count, edge_count, sorted distinct relations, score (edges a node)."""
    n = nodes.agg(F.count("*").alias("node_count"))
    e = edges.agg(F.count("*").alias("edge_count"), F.sort_array(F.collect_set(relation)).alias("relations"))
    return n.join(e, F.lit(True)).withColumn("score", F.col("edge_count") / F.greatest("node_count", F.lit(1)))


def event_graphs(frames: DataFrame) -> DataFrame:
    """One row an event: its graph's nodes and edges as arrays, each mention an actor_of edge to the event."""
    name = F.concat(F.lit("event:"), F.col("record_id"))
    mentions = F.coalesce("entity_mentions", F.array().cast("array<struct<raw_value:string,role:string>>"))
    nodes = F.concat(F.array(F.struct(name.alias("node_id"), F.lit("event").alias("node_type"))), F.transform(mentions, lambda m: F.struct(m["raw_value"].alias("node_id"), F.lit("unknown").alias("node_type"))))
    edges = F.transform(mentions, lambda m: F.struct(m["raw_value"].alias("source"), name.alias("target"), F.lit("actor_of").alias("role")))
    return frames.select("dataset_id", "record_id", nodes.alias("node_records"), edges.alias("edge_records"))


def entity_graphs(rows: DataFrame, mentions: str = "mentions") -> DataFrame:
    """One row an event: nodes of its mentions that have an entity id, no edges. `mentions`: array of (raw_value, role, entity_id, entity_type)."""
    nodes = F.transform(F.filter(mentions, lambda m: m["entity_id"].isNotNull()), lambda m: F.struct(m["entity_id"].alias("node_id"), F.coalesce(m["entity_type"], F.lit("unknown")).alias("node_type")))
    return rows.select("dataset_id", "record_id", F.coalesce(nodes, F.array().cast("array<struct<node_id:string,node_type:string>>")).alias("node_records"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node table."""
    ids = nodes.select("node_id").distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return out.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def tensor_tables(nodes: DataFrame, edges: DataFrame, dim: int = 32, type_buckets: int = 32) -> tuple[DataFrame, DataFrame]:
    """(node_index, node_id, type_id, features), (source_index, target_index, relation_id): graphs as a model reads them.

    Nodes are numbered by id, relations by name. Node features are bytes of type and value.
    """
    value = F.coalesce("value", F.lit("")) if "value" in nodes.columns else F.col("node_id")
    kind = F.coalesce("node_type", F.lit("unknown"))
    type_id = F.pmod(F.conv(F.substring(F.sha2(kind.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(type_buckets)).cast("int")
    # only what features are made of is moved and pinned
    placed = dense_position(nodes.select(*[c for c in ("node_id", "node_type", "value") if c in nodes.columns]), ["node_id"], "node_index")
    indexed = placed.select("node_id", type_id.alias("type_id"), byte_vector(F.concat_ws("|", kind, value), dim).alias("features"), "node_index")
    relations = dense_position(edges.select("role").distinct(), ["role"], "relation_id")
    ids = placed.select("node_id", "node_index")
    out = edges.join(relations, "role").join(ids.withColumnsRenamed({"node_id": "source", "node_index": "source_index"}), "source").join(ids.withColumnsRenamed({"node_id": "target", "node_index": "target_index"}), "target")
    return indexed, out.select("source_index", "target_index", F.col("relation_id").cast("int").alias("relation_id"))


def neighbor_mean(edges: DataFrame, features: DataFrame, source: str = "source", target: str = "target", node: str = "node_id", vector: str = "features") -> DataFrame:
    """(node, mean): the mean of the in-neighbours' vectors, position by position, over edges. Nodes without any have zeros.

    Sums combine before the shuffle, so that a node with very many neighbours costs no more than one. A node's
    sums are one row, as wide as the longest vector, rather than a row for each position.
    """
    spread = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).join(features.select(F.col(node).alias("__s"), F.col(vector).alias("__v")), "__s")
    width = max(1, features.agg(F.max(F.size(vector))).first()[0] or 0)
    sums = spread.groupBy("__t").agg(F.max(F.size("__v")).alias("__n"), *[F.avg(F.get("__v", F.lit(i))).alias(f"__m{i}") for i in range(width)])
    means = sums.where("__n > 0").select("__t", F.slice(F.array(*[f"__m{i}" for i in range(width)]), F.lit(1), F.col("__n")).alias("__mean"))
    zero = F.transform(F.col(vector), lambda x: F.lit(0.0))
    return features.join(means, features[node] == means["__t"], "left").select(F.col(node), F.coalesce("__mean", zero).alias("mean"))
