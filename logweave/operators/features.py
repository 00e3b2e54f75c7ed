"""Frozen feature tables: everything known of an event, joined by its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.vocabulary import FORBIDDEN_COLUMNS, METADATA_COLUMNS, SCHEMA_VERSION

KEY = ["dataset_id", "record_id"]


def missing_inputs(frames: DataFrame, required: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, record_id, missing): events that a required table doesn't have."""
    out = None
    for name, table in required.items():
        gone = frames.join(table, KEY, "left_anti").select(*KEY, F.lit(name).alias("missing"))
        out = gone if out is None else out.unionByName(gone)
    return out


def _required(value: Column, name: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"incomplete feature join, {name}: "), F.concat_ws("/", *KEY))))


def join_features(frames: DataFrame, outputs: DataFrame, micro: DataFrame, macro: DataFrame, entities: DataFrame | None = None, graphs: DataFrame | None = None, hashes: dict[str, str] | None = None) -> DataFrame:
    """One row a frame. `outputs` (key, event_embedding, raw_event_logit, slot_nll), `micro` and `macro` (key, score) are required: an event without one fails the job.

    `entities` (key, entity_summary) and `graphs` (key, graph_embedding, graph_score) may lack events. The
    graph's embedding falls back to the event's; the long-horizon score is the larger of the two windows'.
    """
    out = frames.join(outputs, KEY, "left").join(micro.select(*KEY, F.col("score").alias("micro_window_score")), KEY, "left").join(macro.select(*KEY, F.col("score").alias("macro_window_score")), KEY, "left")
    out = out.join(entities, KEY, "left") if entities is not None else out.withColumn("entity_summary", F.lit(None).cast("map<string,string>"))
    out = out.join(graphs, KEY, "left") if graphs is not None else out.withColumns({"graph_embedding": F.lit(None).cast("array<double>"), "graph_score": F.lit(None).cast("double")})
    producers = F.create_map(*[F.lit(x) for kv in sorted((hashes or {}).items()) for x in kv]).cast("map<string,string>")
    return out.select(
        *KEY, "timestamp", F.array("semantic_confidence").alias("semantic_embedding"), "semantic_confidence", "unknown_score", "entity_summary",
        F.coalesce("graph_embedding", "event_embedding").alias("graph_embedding"), F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"), "event_embedding",
        F.coalesce("slot_nll", F.lit(0.0)).alias("slot_nll"), _required(F.col("raw_event_logit"), "model output").cast("double").alias("raw_event_score"),
        _required(F.col("micro_window_score"), "micro window").cast("double").alias("micro_window_score"), _required(F.col("macro_window_score"), "macro window").cast("double").alias("macro_window_score"),
        F.greatest("micro_window_score", "macro_window_score").alias("long_horizon_score"), "source_record_ref", producers.alias("producer_artifact_hashes"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def model_features(features: DataFrame) -> DataFrame:
    """Without the columns that say where a row comes from."""
    return features.drop(*METADATA_COLUMNS)


def forbidden_columns(df: DataFrame, maps: tuple[str, ...] = ()) -> list[str]:
    """Names of label columns in `df`, and of maps among `maps` in whose keys one is. One count is run if maps are given."""
    found = [c for c in df.columns if c.lower() in FORBIDDEN_COLUMNS]
    if maps:
        hit = lambda m: F.max(F.exists(F.map_keys(m), lambda k: F.lower(k).isin(*FORBIDDEN_COLUMNS)))
        row = df.agg(*[hit(m).alias(m) for m in maps]).first()
        found += [m for m in maps if row[m]]
    return found


def assert_unlabeled(df: DataFrame, maps: tuple[str, ...] = ()) -> DataFrame:
    if found := forbidden_columns(df, maps):
        raise PermissionError(f"labels must not enter here: {', '.join(found)}")
    return df


def invalid_features(features: DataFrame, version: str = "schema_version") -> DataFrame:
    """(record_id, reason) of rows without a version. Raises if dataset_id or attack_id would be a model's feature."""
    if leaked := {"dataset_id", "attack_id"} & set(model_features(features).columns):
        raise ValueError(f"metadata among model features: {', '.join(sorted(leaked))}")
    return features.where(F.coalesce(version, F.lit("")) == "").select("record_id", F.lit("missing_version").alias("reason"))


def frozen_export(rows: DataFrame, hashes: dict[str, str]) -> DataFrame:
    """`rows` with producer hashes and the schema version; a row without ids fails the job."""
    have = F.col("dataset_id").isNotNull() & F.col("record_id").isNotNull() & (F.col("record_id") != "")
    checked = rows.where(F.when(have, F.lit(True)).otherwise(F.raise_error(F.lit("frozen feature without dataset_id or record_id")).cast("boolean")))
    return checked.withColumns({"producer_artifact_hashes": F.create_map(*[F.lit(x) for kv in sorted(hashes.items()) for x in kv]).cast("map<string,string>"), "schema_version": F.lit(SCHEMA_VERSION)})


def window_rows(rows: DataFrame) -> DataFrame:
    """(record_id, timestamp, micro_minutes, macro_minutes); a row without a time fails the job."""
    need = F.when(F.col("timestamp").isNotNull(), F.col("timestamp")).otherwise(F.raise_error(F.lit("window row without a timestamp")))
    return rows.select("record_id", need.cast("string").alias("timestamp"), F.lit(5).alias("micro_minutes"), F.lit(30).alias("macro_minutes"))


def check_version(df: DataFrame, version: str = SCHEMA_VERSION, column: str = "schema_version") -> DataFrame:
    """`df`; a row of another version fails the job, one without a version passes."""
    if column not in df.columns:
        return df
    ok = F.col(column).isNull() | (F.col(column) == version)
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.col(column))).cast("boolean")))
