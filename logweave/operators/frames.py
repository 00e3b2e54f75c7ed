"""Parses to typed event frames, by rules over the message. All column expressions: one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import IP, PATH, any_in, captured, ladder, non_empty

# What is captured for each role, and the words that decide action and outcome, first match first.
ROLE_PATTERNS = {
    "actor": r"(?:user|account|principal)\s+([A-Za-z][\w.-]*)",
    "destination_host": r"host[- ]?([A-Za-z0-9_.-]+)",
    "process": r"(?:process|started)\s+([\w.-]+\.exe)",
    "object": rf"({PATH})",
}
ACTION_RULES = (  # words, family, leaf, relation
    (("login", "logon", "authenticated"), "authentication", "login", "actor_of"),
    (("process", "started", ".exe"), "process", "start", "process_of"),
    (("download",), "file", "download", "object_of"),
    (("accessed", "read"), "file", "read", "object_of"),
    (("connect", "network"), "network", "connect", "destination_of"),
)
OUTCOMES = ((("failed", "denied", "error"), "failure"), (("success", "completed", "ok"), "success"))
KEYWORD_ACTIONS = (
    (("login",), "authenticate"), (("logon",), "authenticate"), (("connect",), "connect"), (("failed",), "fail"), (("error",), "error"), (("delete",), "delete"),
    (("create",), "create"), (("write",), "write"), (("read",), "read"), (("execute",), "execute"), (("start",), "start"), (("stop",), "stop"),
)
KEYWORD_OUTCOMES = ((("fail", "error", "denied", "reject"), "failure"), (("success", "accepted", "complete", "ok"), "success"))
USER_MENTION = r"(?:user|account|login|uid)[=: ]+([A-Za-z0-9_.@\\-]+)"
SEMANTIC_VERSION = "rules-1"
LOW_CONFIDENCE = 0.35


def message_of(parses: DataFrame) -> Column:
    return F.coalesce(F.col("fields")["message"], non_empty(F.col("template_text")), F.col("fields")["template"], F.lit(""))


def extract_frames(parses: DataFrame, message: Column | None = None) -> DataFrame:
    """One frame a parse: action family and leaf, outcome, roles, mentions, confidence.

    Roles hold what was captured, in the order actor, destination_host, process, object,
    destination_ip; mentions are the same as an array of (raw_value, role).
    """
    out = parses.withColumn("__m", message_of(parses) if message is None else message).withColumn("__low", F.lower("__m"))
    found = [(role, captured(F.col("__m"), pattern)) for role, pattern in ROLE_PATTERNS.items()]
    found.append(("destination_ip", non_empty(F.regexp_extract("__m", rf"(?U)(?=\d)\b{IP}\b", 0))))
    mentions = F.filter(F.array(*[F.struct(value.alias("raw_value"), F.lit(role).alias("role")) for role, value in found]), lambda m: m["raw_value"].isNotNull() & (m["raw_value"] != ""))
    of = lambda k: ladder(F.col("__low"), tuple((rule[0], rule[k]) for rule in ACTION_RULES), "unknown")
    out = out.withColumn("entity_mentions", mentions).withColumns({"__family": of(1), "__leaf": of(2), "__relation": of(3)})
    confidence = F.when(F.col("__leaf") != "unknown", 0.9).otherwise(LOW_CONFIDENCE)
    return out.withColumns({
        "record_kind": F.col("__family"), "relation_type": F.col("__relation"), "action_family": F.col("__family"), "action_leaf": F.col("__leaf"),
        "outcome": ladder(F.col("__low"), OUTCOMES, "unknown"), "roles": F.map_from_entries(F.transform("entity_mentions", lambda m: F.struct(m["role"], m["raw_value"]))),
        "entities": F.transform("entity_mentions", lambda m: m["raw_value"]), "semantic_confidence": confidence, "unknown_score": 1 - confidence, "semantic_version": F.lit(SEMANTIC_VERSION),
    }).drop("__m", "__low", "__family", "__leaf", "__relation")


def mentions_of(text: Column) -> Column:
    """Addresses, then paths, then names after user, account, login or uid: each once, in that order."""
    users = F.regexp_extract_all(text, F.lit(f"(?i){USER_MENTION}"), 1)
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(rf"(?U)(?=\d)\b({IP})\b"), 1), F.regexp_extract_all(text, F.lit(rf"(?U)({PATH})"), 1), users))


def actor_of(mentions: Column) -> Column:
    """The first mention with a backslash or an @, else unknown."""
    return F.coalesce(F.get(F.filter(mentions, lambda m: m.contains("\\") | m.contains("@")), F.lit(0)), F.lit("unknown"))


def object_of(mentions: Column) -> Column:
    """The first mention that is a path, else unknown."""
    return F.coalesce(F.get(F.filter(mentions, lambda m: F.regexp_like(m, F.lit(r"^(?:/|[A-Za-z]:\\)"))), F.lit(0)), F.lit("unknown"))


def keyword_frames(parses: DataFrame, text: Column, confidence: Column | None = None) -> DataFrame:
    """Simple frames: action and outcome by keyword, mentions, actor, object; a parse's confidence is cut by a quarter without an action."""
    low = F.lower(text)
    out = parses.withColumns({"action": ladder(low, KEYWORD_ACTIONS, "unknown"), "outcome": ladder(low, KEYWORD_OUTCOMES, "unknown"), "entities": mentions_of(text)})
    sure = (F.lit(1.0) if confidence is None else confidence) * F.when(F.col("action") == "unknown", 0.75).otherwise(1.0)
    out = out.withColumns({"actor": actor_of(F.col("entities")), "object": object_of(F.col("entities")), "semantic_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))})
    return out.withColumn("quarantined_reason", F.when(F.col("semantic_confidence") < LOW_CONFIDENCE, "low_semantic_confidence"))


def enrich(frames: DataFrame, taxonomy: DataFrame, key: str = "template_id", attributes: str = "attributes") -> DataFrame:
    """Adds to the map `attributes` what `taxonomy` (key, attributes) says of a frame's template, but nothing whose name contains "label".

    How the tables join is left to Spark, which knows their sizes.
    """
    extra = taxonomy.select(key, F.map_filter(attributes, lambda k, v: ~F.lower(k).contains("label")).alias("__extra"))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.col(attributes), empty) if attributes in frames.columns else empty
    both = frames.join(extra, key, "left").withColumn("__own", own)
    kept = F.map_filter("__own", lambda k, v: ~F.map_contains_key(F.coalesce("__extra", empty), k))
    return both.withColumn(attributes, F.map_concat(kept, F.coalesce("__extra", empty))).drop("__extra", "__own")


#: Columns of an event frame that get a default where the input has none.
FRAME_DEFAULTS = {
    "record_kind": "'unknown'", "relation_type": "'unknown'", "action_family": "'unknown'", "action_leaf": "'unknown'", "roles": "cast(map() as map<string,string>)", "outcome": "'unknown'",
    "key_attributes": "cast(map() as map<string,string>)", "entity_mentions": "cast(array() as array<struct<raw_value:string,role:string>>)", "semantic_confidence": "0.0D", "unknown_score": "1.0D", "source_record_ref": "''", "semantic_version": "'mock'",
}


def default_frames(rows: DataFrame) -> DataFrame:
    """Frames from rows that may lack columns or values. A row without an id or dataset fails the job."""
    has = set(rows.columns)
    ids = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("record_id", "raw_record_id") if c in has])
    need = lambda c, name: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"event frame without {name}")))
    times = [F.col(c) for c in ("timestamp", "raw_timestamp") if c in has] or [F.lit(None).cast("string")]
    rest = [F.coalesce(F.col(c), F.expr(d)).alias(c) if c in has else F.expr(d).alias(c) for c, d in FRAME_DEFAULTS.items()]
    return rows.select(need(F.col("dataset_id"), "dataset_id").alias("dataset_id"), need(ids, "record_id").alias("record_id"), F.coalesce(*times).alias("timestamp"), *rest)


def flagged(frames: DataFrame, words: tuple[str, ...], text: str) -> DataFrame:
    """Adds flagged: whether `text` contains one of the words."""
    return frames.withColumn("flagged", any_in(F.lower(F.coalesce(text, F.lit(""))), words))
