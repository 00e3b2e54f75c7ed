"""From log lines to scored, joined features: the whole chain on one dataset."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.vectors import byte_vector, serialized
from logweave.operators import entities, features, graph, history, links, windows
from logweave.operators.frames import extract_frames
from logweave.operators.parse import parse, split_quarantine
from logweave.operators.pinning import pin_table
from logweave.sources.readers import read_timed_text


@dataclass
class LogRun:
    """A run over lines that begin with a time: every table by stage, made when it is first asked for, with what it needs.

    Cut points that feed several outputs are written once. Windows further apart than `max_gap_seconds`
    aren't paired; queues join them through those between. Embeddings are bytes of a frame's fields and the event logit
    is that of its confidence: stand-ins for a trained model's, which join_features takes in their place.
    """

    spark: SparkSession
    path: str
    dataset_id: str
    dim: int = 32
    last: int = 64
    whole_files: bool = False
    max_gap_seconds: float = 86_400.0

    @cached_property
    def raw(self) -> DataFrame:
        return pin_table(read_timed_text(self.spark, self.path, self.dataset_id, self.whole_files), "raw")

    @cached_property
    def parses(self) -> DataFrame:
        return pin_table(parse(self.raw), "parses")

    @cached_property
    def quarantine(self) -> DataFrame:
        return split_quarantine(self.parses)[1]

    @cached_property
    def frames(self) -> DataFrame:
        return pin_table(extract_frames(split_quarantine(self.parses)[0]).withColumn("ts", F.to_timestamp("timestamp")), "frames")

    @cached_property
    def mentions(self) -> DataFrame:
        return pin_table(entities.mention_entities(self.frames), "mentions")

    @cached_property
    def entities(self) -> DataFrame:
        return entities.entities_of(self.mentions)

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.strict_graph(self.frames, entities.links_of(self.mentions))

    @property
    def nodes(self) -> DataFrame:
        return self._graph[0]

    @property
    def edges(self) -> DataFrame:
        return self._graph[1]

    @cached_property
    def histories(self) -> DataFrame:
        return history.ranged_history(self.frames, ["dataset_id"], ["record_id"], self.last)

    @cached_property
    def _long(self) -> DataFrame:
        return self.mentions.select(F.col("event_id").alias("record_id"), "raw_value", "role")

    @cached_property
    def _scored(self) -> DataFrame:
        return self.frames.withColumn("logit", F.log(F.col("semantic_confidence") / (1 - F.col("semantic_confidence"))))

    @cached_property
    def _vectors(self) -> DataFrame:
        return self._scored.select("record_id", byte_vector(serialized(F.col("roles")), self.dim).alias("vector"))

    def _windows(self, minutes: int) -> DataFrame:
        return pin_table(windows.window_table(self._scored, self._long, minutes, score="logit", vectors=self._vectors, dim=self.dim), "windows")

    @cached_property
    def micro(self) -> DataFrame:
        return self._windows(windows.MICRO)

    @cached_property
    def macro(self) -> DataFrame:
        return self._windows(windows.MACRO)

    @cached_property
    def anchors(self) -> DataFrame:
        return pin_table(windows.window_entities(self.frames, self._long, windows.MICRO), "anchors")

    @cached_property
    def pairs(self) -> DataFrame:
        return links.window_pairs(self.anchors, self.max_gap_seconds)

    @cached_property
    def links(self) -> DataFrame:
        sides = self.micro.select("window_id", "actions", F.col("event_ids").alias("path_nodes"), F.col("embedding").alias("graph_embedding"))
        return pin_table(links.default_link_score(links.link_evidence(links.window_links(self.anchors, self.max_gap_seconds), sides)), "links")

    @cached_property
    def queues(self) -> DataFrame:
        return links.attack_queues(links.anchor_chains(self.anchors, self.max_gap_seconds))

    @cached_property
    def features(self) -> DataFrame:
        frames, scored = self.frames, self._scored
        by_event = lambda w, m: links.scores_by_event(w, windows.window_events(frames, m)).select(F.lit(self.dataset_id).alias("dataset_id"), F.col("event_id").alias("record_id"), "score")
        outputs = scored.select("dataset_id", "record_id", "logit").join(self._vectors, "record_id").select("dataset_id", "record_id", F.col("vector").alias("event_embedding"), F.col("logit").alias("raw_event_logit"), F.lit(0.0).alias("slot_nll"))
        summary = entities.event_summary(self.mentions).select("dataset_id", F.col("event_id").alias("record_id"), F.create_map(F.lit("entity_count"), F.col("entity_count").cast("string"), F.lit("entity_types"), F.array_join("entity_types", ",")).alias("entity_summary"))
        score = graph.graph_summary(self.nodes, self.edges).select("score")
        graphs = frames.select("dataset_id", "record_id").join(score, F.lit(True)).select("dataset_id", "record_id", F.lit(None).cast("array<double>").alias("graph_embedding"), F.col("score").alias("graph_score"))
        return features.join_features(frames, outputs, by_event(self.micro, windows.MICRO), by_event(self.macro, windows.MACRO), summary, graphs)


def run_log_pipeline(spark: SparkSession, path: str, dataset_id: str, dim: int = 32, last: int = 64, whole_files: bool = False, max_gap_seconds: float = 86_400.0) -> LogRun:
    """The whole chain on one dataset; see LogRun."""
    return LogRun(spark, path, dataset_id, dim, last, whole_files, max_gap_seconds)


def preprocess(raw: DataFrame) -> dict[str, DataFrame]:
    """The simple path: masked templates, keyword frames, simple entities and one weighted graph over all records."""
    from logweave.operators.frames import keyword_frames
    from logweave.operators.templates import masked

    parses = masked(parse(raw), "template_text")
    frames = keyword_frames(parses, F.col("template"))
    resolved = entities.resolve_values(frames)
    keyed = frames.select("record_id", "action", "outcome", F.col("timestamp"), "source_file", "source_line")
    nodes, edges = graph.weighted_graph(keyed, resolved, ["source_file", "source_line"])
    return {"frames": frames, "entities": resolved, "nodes": nodes, "edges": edges}
