"""Mentions to scoped entities and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ids import entity_id, node_id
from logweave.functions.text import WHOLE_IP, is_blank

SPACE_ENDS = r"(?U)^\s+|\s+$"


def _ip(raw: Column) -> Column:
    return F.regexp_like(raw, F.lit(WHOLE_IP))


def type_by_role(raw: Column, role: Column) -> Column:
    """ip by its form, else by role: user, host, process, file; paths are files too; else unknown."""
    return (
        F.when(_ip(raw), "ip").when(role == "actor", "user").when(role == "destination_host", "host").when(role == "process", "process")
        .when((role == "object") | raw.startswith("/") | raw.startswith("C:\\"), "file").otherwise("unknown")
    )


def type_by_form(value: Column) -> Column:
    """ip, path, account or token."""
    return F.when(_ip(value), "ip").when(F.regexp_like(value, F.lit(r"^(?:/|[A-Za-z]:\\)")), "path").when(value.contains("@") | value.contains("\\"), "account").otherwise("token")


def canonical(value: Column, kind: Column, platform: Column) -> Column:
    """Names lower-cased; files with the platform's slashes, lower-cased but on linux; addresses as they are; else white space collapsed."""
    value = F.regexp_replace(value, SPACE_ENDS, "")
    file = F.when(F.lower(platform) == "linux", F.replace(value, F.lit("\\"), F.lit("/"))).otherwise(F.lower(F.replace(value, F.lit("/"), F.lit("\\"))))
    return F.when(kind.isin("user", "domain", "service"), F.lower(value)).when(kind == "file", file).when(kind == "ip", value).otherwise(F.regexp_replace(value, r"(?U)\s+", " "))


def canonical_simple(value: Column, kind: Column) -> Column:
    """Addresses as they are; else forward slashes, none at the end, lower-cased."""
    value = F.regexp_replace(value, SPACE_ENDS, "")
    return F.when(kind == "ip", value).otherwise(F.lower(F.rtrim(F.replace(value, F.lit("\\"), F.lit("/")), F.lit("/"))))


def context(kind: Column, host: Column, raw: Column, timestamp: Column) -> Column:
    """What an entity's identity hangs on: the host, and for a process also its name and the event's time."""
    host = F.coalesce(host, F.lit(""))
    return F.when(kind == "process", F.concat_ws("|", host, raw, F.coalesce(timestamp.cast("string"), F.lit("")))).otherwise(host)


def mention_entities(frames: DataFrame) -> DataFrame:
    """One row a mention with text: entity and link in one. Frames need dataset_id, record_id, timestamp, roles, entity_mentions, source_record_ref."""
    host = F.coalesce(F.col("roles")["destination_host"], F.lit(""))
    rows = frames.select("dataset_id", F.col("record_id").alias("event_id"), "timestamp", host.alias("host_scope"), "source_record_ref", F.posexplode("entity_mentions").alias("position", "m"))
    rows = rows.select("*", F.regexp_replace("m.raw_value", SPACE_ENDS, "").alias("raw_value"), F.coalesce("m.role", F.lit("unknown")).alias("role")).drop("m").where(~is_blank(F.col("raw_value")))
    rows = rows.withColumn("entity_type", type_by_role(F.col("raw_value"), F.col("role")))
    rows = rows.withColumn("canonical_value", canonical(F.col("raw_value"), F.col("entity_type"), F.when(F.col("raw_value").contains("\\"), "windows").otherwise("linux")))
    rows = rows.withColumn("instance_key", context(F.col("entity_type"), F.col("host_scope"), F.col("raw_value"), F.col("timestamp")))
    rows = rows.withColumn("entity_id", entity_id("dataset_id", "entity_type", "canonical_value", "instance_key"))
    return rows.withColumn("confidence", F.when(F.col("entity_type") == "ip", 0.4).otherwise(0.9)).withColumn("resolution_method", F.lit("m1_role_rule"))


def links_of(mentions: DataFrame) -> DataFrame:
    return mentions.select("dataset_id", "event_id", "entity_id", "role", "confidence")


def entities_of(mentions: DataFrame) -> DataFrame:
    """One row an entity: first and last seen, how often, and its first spelling."""
    when = F.struct("timestamp", "event_id", "position")
    return mentions.groupBy("entity_id").agg(
        F.min("dataset_id").alias("dataset_id"), F.min("entity_type").alias("entity_type"), F.min_by("raw_value", when).alias("raw_value"), F.min("canonical_value").alias("canonical_value"),
        F.min("instance_key").alias("instance_key"), F.min("host_scope").alias("host_scope"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"),
    )


def resolve_values(frames: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Simple entities of frames' value arrays: type by form, canonical value, alias if `aliases` (canonical_value, entity_type, alias) has one, id."""
    rows = frames.select("record_id", F.posexplode("entities").alias("position", "value"))
    rows = rows.withColumn("entity_type", type_by_form(F.col("value"))).withColumn("canonical_value", canonical_simple(F.col("value"), F.col("entity_type")))
    if aliases is not None:
        known = aliases.select("canonical_value", "entity_type", F.nullif(F.lower(F.regexp_replace("alias", SPACE_ENDS, "")), F.lit("")).alias("__alias")).dropDuplicates(["canonical_value", "entity_type"])
        rows = rows.join(known, ["canonical_value", "entity_type"], "left").withColumn("canonical_value", F.coalesce("__alias", "canonical_value")).drop("__alias")
    value = F.concat_ws("|", "entity_type", "canonical_value")
    return rows.select("record_id", "position", node_id("entity_type", value).alias("entity_id"), "entity_type", "value", "canonical_value", F.lit(0.95).alias("confidence"))


def rule_entities(rows: DataFrame) -> DataFrame:
    """Typed rows with defaults for what they lack."""
    defaults = {"entity_type": F.lit("unknown"), "canonical_value": F.col("raw_value"), "instance_key": F.lit(""), "confidence": F.lit(0.5), "resolution_method": F.lit("rule")}
    filled = rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})
    return filled.withColumn("entity_id", entity_id("dataset_id", "entity_type", "canonical_value", "instance_key"))


def score_pairs(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """Adds score and reason to rows with two entity structs: only equal ids in one scope that aren't addresses score 1."""
    a, b = F.col(left), F.col(right)
    apart = (a["dataset_id"] != b["dataset_id"]) | (a["entity_type"] != b["entity_type"])
    same = a["entity_id"] == b["entity_id"]
    reason = F.when(apart, "scope_mismatch").when(a["entity_type"] == "ip", "weak_ip_only").when(same, "canonical_and_scope_match").otherwise("no_match")
    return pairs.withColumn("reason", reason).withColumn("score", F.when(reason == "canonical_and_scope_match", 1.0).otherwise(0.0))


def matching_mentions(mentions: DataFrame) -> DataFrame:
    """(entity_id, mentions, events) of entities that match themselves across events: the pairs with a score, as groups rather than pairs."""
    per = mentions.where("entity_type <> 'ip'").groupBy("dataset_id", "entity_type", "entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("event_id").alias("events"))
    return per.where("events > 1")


def latest(updates: DataFrame, key: str = "entity_id", order: str = "timestamp") -> DataFrame:
    """The last row of each key, by a struct maximum that combines before the shuffle."""
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("__last")).select(key, "__last.*")


def event_summary(mentions: DataFrame) -> DataFrame:
    """(event_id, entity_count, entity_types)."""
    return mentions.groupBy("dataset_id", "event_id").agg(F.count("*").alias("entity_count"), F.sort_array(F.collect_set("entity_type")).alias("entity_types"))
