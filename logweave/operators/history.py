"""What was known before an event: strictly earlier events, and checks that nothing later leaks in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.numbering import dense_position
from logweave.operators.parse import event_order


def causal_history(events: DataFrame, by: list[str], keep: list[str], last: int | None = None, order: list | None = None) -> DataFrame:
    """Adds history_size (of all earlier events of the same `by`) and history, the last `last` of them as structs of `keep`, oldest first.

    Without `last` the whole history of each event is kept, which grows with the square of a group: for
    small groups, or tests. A group is ordered in one task, so `by` should name an actor; for a whole
    dataset there is ranged_history.
    """
    order = order or event_order()
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding if last is None else -last, -1)
    seen = W.partitionBy(*by).orderBy(*order)
    return events.withColumn("history_size", F.row_number().over(seen).cast("long") - 1).withColumn("history", F.collect_list(F.struct(*keep)).over(before))


def ranged_history(events: DataFrame, by: list[str], keep: list[str], last: int, order: list | None = None, block: int = 4096) -> DataFrame:
    """As causal_history, for groups of any size: no group is ordered in one task.

    Events are numbered through range partitions and cut into blocks of their group; each block also
    sees the last `last` events of the one before.
    """
    order, size = order or event_order(), max(block, last)
    placed = dense_position(events, [*by, *order], "__at")
    first = placed.groupBy(*by).agg(F.min("__at").alias("__first"))
    named = first.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__first")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    own = placed.join(named, same).withColumn("history_size", F.col("__at") - F.col("__first"))
    inside = F.pmod("history_size", F.lit(size))
    blocks = F.when(inside >= size - last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = own.withColumn("__ahead", F.explode(blocks)).withColumn("__block", F.floor(F.col("history_size") / size) + F.col("__ahead"))
    before = W.partitionBy(*by, "__block").orderBy("history_size").rowsBetween(-last, -1)
    out = seen.withColumn("history", F.collect_list(F.struct(*keep)).over(before)).where("__ahead = 0")
    return out.select(*events.columns, "history_size", "history")


def history_within(events: DataFrame, by: list[str], keep: list[str], seconds: float, order: list | None = None, ts: str = "ts") -> DataFrame:
    """Adds history, all earlier events of the same `by` within the last `seconds` as structs of `keep`, oldest first, and history_size, their number.

    Time is cut into slots of that length; each slot also sees the events of the one before, so however
    long a group is, what meets in one task is two slots of it. Earlier is as in event_order, so of events with one time some come before others.
    An event without a time has no history and is in none.
    """
    order, span = order or event_order(), int(seconds * 1_000_000)
    at = F.unix_micros(ts)
    own = events.withColumns({"__key": F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)]), "__at": at, "__slot": F.floor(at / span)})
    seen = own.withColumn("__ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__block", F.col("__slot") + F.col("__ahead"))
    frame = W.partitionBy(*by, "__block").orderBy("__at").rangeBetween(-span, 0)
    found = seen.withColumn("__past", F.collect_list(F.struct("__key", F.struct(*keep).alias("kept"))).over(frame)).where("__ahead = 0")
    past = F.transform(F.array_sort(F.filter("__past", lambda h: (h["__key"] < F.col("__key")) & F.col("__at").isNotNull())), lambda h: h["kept"])
    out = found.withColumn("history", past).withColumn("history_size", F.size("history").cast("long"))
    return out.select(*events.columns, "history_size", "history")


def history_before(events: DataFrame, current_id: str) -> DataFrame:
    """The events of the current one's dataset that come before it in the total order."""
    names = ["__ts", "source_file", "source_line", "record_id"]
    keyed = events.withColumn("__key", F.struct(*[c.alias(n) for c, n in zip(event_order(), names, strict=True)]))
    now = keyed.where(F.col("record_id") == current_id).select(F.col("dataset_id").alias("__d"), F.col("__key").alias("__now"))
    return keyed.join(now, keyed["dataset_id"].eqNullSafe(now["__d"]) & (keyed["__key"] < now["__now"])).drop("__d", "__now", "__key")


def links_before(links: DataFrame, history: DataFrame) -> DataFrame:
    """The links of events in the history."""
    return links.join(history.select("dataset_id", F.col("record_id").alias("event_id")).distinct(), ["dataset_id", "event_id"], "left_semi")


def all_but(frames: DataFrame, current_id: str) -> DataFrame:
    """All events but the current one: later ones stay."""
    return frames.where(~F.col("record_id").eqNullSafe(F.lit(current_id)))


def leaks(batches: DataFrame) -> DataFrame:
    """Rows of causal batches (record_id, history, graph_nodes, graph_edges) whose own event is in their past, with a reason.

    The node of an event is named event:<id>; a graph that merely says whose past it is leaks nothing.
    """
    own = F.concat(F.lit("event:"), F.col("record_id"))
    reason = (
        F.when(F.exists("history", lambda h: h["record_id"] == F.col("record_id")), "history")
        .when(F.exists("graph_nodes", lambda n: n["node_id"] == own), "graph_node")
        .when(F.exists("graph_edges", lambda e: (e["source"] == own) | (e["target"] == own)), "graph_edge")
    )
    return batches.withColumn("reason", reason).where("reason is not null").select("record_id", "reason")


def require_no_leak(batches: DataFrame) -> DataFrame:
    """`batches`; a row with its own event in its history fails the job."""
    bad = F.exists("history", lambda h: h["record_id"] == F.col("record_id"))
    return batches.where(F.when(~F.coalesce(bad, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("current event in its history: "), F.col("record_id"))).cast("boolean")))
