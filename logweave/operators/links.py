"""Windows that share an anchor, and the queues that such links join.

A user or process in common is a strong anchor, a host a medium one; an address alone links nothing.
Windows meet through an equi-join on anchors, never all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.scores import decays, sigmoid
from logweave.functions.vectors import cosine, jaccard
from logweave.operators.components import components
from logweave.operators.numbering import dense_position
from logweave.operators.pinning import pin, pin_table

STRONG, MEDIUM, WEAK = ("user", "process"), ("host",), ("ip",)
ANCHOR_WEIGHTS = {"strong": 1.0, "medium": 0.5, "weak": 0.0}


def _pairs(entities: DataFrame, on: list[str], max_gap_seconds: float | None) -> DataFrame:
    """(source_window, target_window, source_start, target_start, entity_type, value): earlier window first, ties by id."""
    a = entities.select(F.col("window_id").alias("source_window"), F.col("window_start").alias("source_start"), "entity_type", "value")
    b = entities.select(F.col("window_id").alias("target_window"), F.col("window_start").alias("target_start"), F.col("entity_type").alias("target_type"), F.col("value").alias("target_value"))
    equal = F.col("value") == F.col("target_value")
    if "entity_type" in on:
        equal = equal & (F.col("entity_type") == F.col("target_type"))
    if max_gap_seconds is None:
        after = F.struct("source_start", "source_window") < F.struct("target_start", "target_window")
        return a.join(b, equal & after)
    # with a bound, windows also meet by time: each in its own slot of that length, and as a target in the one before too
    slot = lambda c: F.floor(F.col(c).cast("double") / max_gap_seconds).cast("long")
    a = a.withColumn("slot", slot("source_start"))
    b = b.withColumn("target_slot", F.explode(F.array(slot("target_start"), slot("target_start") - 1)))
    after = F.struct("source_start", "source_window") < F.struct("target_start", "target_window")
    near = F.col("target_start").cast("double") - F.col("source_start").cast("double") <= max_gap_seconds
    return a.join(b, equal & (F.col("slot") == F.col("target_slot")) & after & near).drop("slot", "target_slot")


def _seconds(a: str, b: str) -> Column:
    return F.greatest(F.col(b).cast("double") - F.col(a).cast("double"), F.lit(0.0))


def window_links(entities: DataFrame, max_gap_seconds: float | None) -> DataFrame:
    """(source_window, target_window, anchors, anchor_strength, n_strong, n_medium, delta_seconds) from (window_id, window_start, entity_type, value).

    Pairs grow with the density in time of an anchor's windows. A gap of None has no bound: an anchor of n
    windows then gives n² / 2 pairs, which only small data can bear.
    """
    useful = entities.where(F.col("entity_type").isin(*STRONG, *MEDIUM))
    strong = F.col("entity_type").isin(*STRONG)
    both = _pairs(useful, ["entity_type", "value"], max_gap_seconds)
    found = both.groupBy("source_window", "target_window", "source_start", "target_start").agg(
        F.sort_array(F.collect_set("value")).alias("anchors"), F.size(F.collect_set(F.when(strong, F.col("value")))).cast("long").alias("n_strong"), F.size(F.collect_set(F.when(~strong, F.col("value")))).cast("long").alias("n_medium"),
    )
    strength = F.when(F.col("n_strong") > 0, "strong").otherwise("medium")
    return found.select("source_window", "target_window", "anchors", strength.alias("anchor_strength"), "n_strong", "n_medium", _seconds("source_start", "target_start").alias("delta_seconds"))


def anchor_chains(entities: DataFrame, max_gap_seconds: float) -> DataFrame:
    """(source_window, target_window): each anchor's windows in order of time, each linked to the next one if the gap fits.

    Two windows of an anchor within the gap have only such gaps between them, so the chains connect
    exactly what window_links connects, with one row a window instead of all pairs.
    """
    order = W.partitionBy("entity_type", "value").orderBy("window_start", "window_id")
    before = lambda c: F.lag(c).over(order)
    useful = entities.where(F.col("entity_type").isin(*STRONG, *MEDIUM)).select("entity_type", "value", "window_start", "window_id").distinct()
    gap = F.col("window_start").cast("double") - F.col("before_start").cast("double")
    return useful.select(before("window_id").alias("source_window"), F.col("window_id").alias("target_window"), before("window_start").alias("before_start"), "window_start").where(gap <= max_gap_seconds).select("source_window", "target_window")


def window_pairs(entities: DataFrame, max_gap_seconds: float | None) -> DataFrame:
    """(source_window, target_window, shared_strong_entities, shared_ip_entities, candidate, rejected_reason): pairs that share anything.

    The gap is as in window_links. Here a user, host or process matches any of these by its text alone. A pair with only addresses in
    common is rejected as ip_only_anchor.
    """
    strong = _pairs(entities.where(F.col("entity_type").isin(*STRONG, *MEDIUM)).withColumn("entity_type", F.lit("strong")).distinct(), ["value"], max_gap_seconds)
    weak = _pairs(entities.where(F.col("entity_type").isin(*WEAK)), ["entity_type", "value"], max_gap_seconds)
    rows = strong.select("source_window", "target_window", "value", F.lit(True).alias("s")).unionByName(weak.select("source_window", "target_window", "value", F.lit(False).alias("s")))
    out = rows.groupBy("source_window", "target_window").agg(F.sort_array(F.collect_set(F.when(F.col("s"), F.col("value")))).alias("shared_strong_entities"), F.sort_array(F.collect_set(F.when(~F.col("s"), F.col("value")))).alias("shared_ip_entities"))
    out = out.withColumn("candidate", F.size("shared_strong_entities") > 0)
    return out.withColumn("rejected_reason", F.when(~F.col("candidate"), "ip_only_anchor"))


def time_adjacent_links(windows: DataFrame, max_gap_seconds: float) -> DataFrame:
    """(source_window, target_window): each window with the next one in time, whatever they hold, if the gap fits. A baseline.

    Windows are numbered through ranges of time, so that neighbours meet by an equi-join over the borders too.
    """
    placed = dense_position(windows.select("window_id", "window_start").distinct(), ["window_start", "window_id"], "at")
    placed = pin_table(placed, "window_order")
    after = placed.select(F.col("window_id").alias("target_window"), F.col("window_start").alias("target_start"), (F.col("at") - 1).alias("at"))
    fits = F.col("target_start").cast("double") - F.col("window_start").cast("double") <= max_gap_seconds
    return placed.join(after, "at").where(fits).select(F.col("window_id").alias("source_window"), "target_window")


def any_overlap_links(entities: DataFrame, max_gap_seconds: float | None) -> DataFrame:
    """(source_window, target_window) of windows that share any entity, addresses too. A baseline."""
    return _pairs(entities, ["entity_type", "value"], max_gap_seconds).select("source_window", "target_window").distinct()


def link_quality(links: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """(links, n_links, n_right, precision) of link sets side by side. `truth`: window_id, label; a link is right if both windows have one label in common. Without links the precision is null."""
    known = pin_table(truth.select("window_id", "label").distinct(), "link_truth")
    side = lambda p: known.select(F.col("window_id").alias(f"{p}_window"), F.col("label").alias("__label"))
    rows = []
    for name, df in links.items():
        own = pin_table(df.select("source_window", "target_window").distinct(), "link_set")  # counted, and met with the truth
        right = own.join(side("source"), "source_window").join(side("target"), ["target_window", "__label"]).select("source_window", "target_window").distinct()
        both = own.agg(F.count("*").alias("n_links")).join(right.agg(F.count("*").alias("n_right")), F.lit(True))
        rows.append(both.select(F.lit(name).alias("links"), "n_links", "n_right", (F.col("n_right") / F.nullif("n_links", F.lit(0))).alias("precision")))
    return reduce(DataFrame.unionByName, rows)


def entity_rarity(entities: DataFrame) -> DataFrame:
    """(value, rarity): log of windows over the windows that have the value."""
    total = entities.agg(F.countDistinct("window_id").alias("n"))
    per = entities.groupBy("value").agg(F.countDistinct("window_id").alias("df"))
    return per.join(total, F.lit(True)).select("value", F.log(F.col("n") / F.col("df")).alias("rarity"))


def link_evidence(links: DataFrame, windows: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """Adds anchor_score, stable_rarity, action_compatibility, path_coherence, graph_cosine to links.

    `windows`: window_id, actions, path_nodes, graph_embedding. Rarity is the mean over a link's
    anchors, 0 for unknown ones.
    """
    side = lambda p: windows.select(F.col("window_id").alias(f"{p}_window"), *[F.col(c).alias(f"{p}_{c}") for c in ("actions", "path_nodes", "graph_embedding")])
    out = links.join(side("source"), "source_window").join(side("target"), "target_window")
    out = out.withColumns({
        "anchor_score": ANCHOR_WEIGHTS["strong"] * F.col("n_strong") + ANCHOR_WEIGHTS["medium"] * F.col("n_medium"),
        "action_compatibility": F.when(F.arrays_overlap("source_actions", "target_actions"), 1.0).otherwise(0.0),
        "path_coherence": jaccard(F.col("source_path_nodes"), F.col("target_path_nodes")), "graph_cosine": cosine(F.col("source_graph_embedding"), F.col("target_graph_embedding")),
    })
    keep = [*links.columns, "anchor_score", "stable_rarity", "action_compatibility", "path_coherence", "graph_cosine"]
    if rarity is None:
        return out.withColumn("stable_rarity", F.lit(0.0)).select(*keep)
    rare = links.select("source_window", "target_window", F.explode("anchors").alias("value")).join(rarity, "value", "left")
    mean = rare.groupBy("source_window", "target_window").agg(F.avg(F.coalesce("rarity", F.lit(0.0))).alias("stable_rarity"))
    return out.join(mean, ["source_window", "target_window"], "left").withColumn("stable_rarity", F.coalesce("stable_rarity", F.lit(0.0))).select(*keep)


def default_link_score(links: DataFrame) -> DataFrame:
    """Adds score where no weights were learned: a logistic of -1 + anchors + half of actions, paths and graph + decay over six hours."""
    z = F.lit(-1.0) + F.col("anchor_score") + 0.5 * (F.col("action_compatibility") + F.col("path_coherence") + F.col("graph_cosine")) + decays(F.col("delta_seconds"))[1]
    return links.withColumn("score", sigmoid(z))


def above(links: DataFrame, threshold: float = 0.5) -> DataFrame:
    return links.where(F.col("score") >= threshold)


def queue_members(links: DataFrame) -> DataFrame:
    """(window_id, root): which queue, known by its smallest window, each linked window is in."""
    found = components(links, "source_window", "target_window")
    return found.select(F.col("node").alias("window_id"), "root").unionByName(found.select(F.col("root").alias("window_id"), "root").distinct())


def attack_queues(links: DataFrame) -> DataFrame:
    """(queue_id, window_ids): components of the links, numbered from 0 in the order of their sorted members.

    Queues are disjoint, so their order is that of their smallest members.
    """
    members = pin(queue_members(links))
    sets = members.groupBy("root").agg(F.sort_array(F.collect_set("window_id")).alias("window_ids"))
    return dense_position(sets, ["root"], "n").select(F.format_string("attack_queue_%04d", "n").alias("queue_id"), "window_ids")


def suspicious_values(entities: DataFrame) -> DataFrame:
    """The distinct values of all windows, in order."""
    return entities.select("value").distinct().orderBy("value")


def entity_memory(entities: DataFrame, order: str = "window_start") -> DataFrame:
    """(entity_type, value, windows): the windows of each entity in order of time."""
    when = F.array_sort(F.collect_list(F.struct(order, "window_id")))
    return entities.groupBy("entity_type", "value").agg(F.transform(when, lambda w: w["window_id"]).alias("windows"))


def scores_by_event(windows: DataFrame, members: DataFrame, score: str = "suspicious_score") -> DataFrame:
    """(event_id, score): a window's score for each of its events. `members`: window_id, event_id."""
    return members.join(windows.select("window_id", F.col(score).alias("score")), "window_id").select("event_id", "score")
