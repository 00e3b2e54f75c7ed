"""As-of joins: each row with the last one of another table at or before its time, and metrics that rest on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.pinning import pin_table


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, name: str = "last") -> DataFrame:
    """`left` with `name`, a struct of the last row of `right` with the same `by` whose `on` is at or before its own; null without one.

    Both tables are dealt by ranges of (by, on) together. In a range the last right row is carried
    along; what a range hands on to the next ones is one row. So neither a key nor the whole is ordered in one task. Of right rows with equal
    keys and times any one counts. Rows of `left` with a null time or key get null, nulls in `right` match nothing.
    """
    by = by or []
    keys = [*by, on]
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    own = left.select(F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType).alias("__right"), F.lit(1).alias("__kind"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    other = right.where(known).select(F.lit(None).cast(own.schema["__left"].dataType).alias("__left"), F.struct(*right.columns).alias("__right"), F.lit(0).alias("__kind"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    order = [*[f"__k{i}" for i in range(len(keys))], "__kind"]
    dealt = pin_table(own.unionByName(other).repartitionByRange(*order[:-1]).withColumn("__part", F.spark_partition_id()), "as_of")
    seen = F.last("__right", ignorenulls=True)
    ends = dealt.where("__kind = 0").groupBy("__part").agg(F.max_by("__right", F.struct(*order)).alias("__end"))
    parts = dealt.select("__part").distinct().join(ends, "__part", "left")
    handed = parts.select("__part", F.last("__end", ignorenulls=True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__handed"))
    inside = dealt.withColumn("__seen", seen.over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    # a row for each range
    found = inside.where("__kind = 1").join(F.broadcast(handed), "__part").withColumn("__last", F.coalesce("__seen", "__handed"))
    same = reduce(lambda x, y: x & y, [F.col("__last")[k] == F.col(f"__k{i}") for i, k in enumerate(by)], F.lit(True)) & F.col(f"__k{len(keys) - 1}").isNotNull()
    return found.select("__left.*", F.when(same, F.col("__last")).alias(name))


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000


def matched_alerts(alerts: DataFrame, attacks: DataFrame, horizon_seconds: float, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """`alerts` with start, the attack that they tell of: the last one of the same `by` that began at or before them, within the horizon; else null."""
    starts = attacks.select(*(by or []), ts).distinct()
    found = as_of(alerts, starts, ts, by, "__attack")
    near = _seconds(F.col("__attack")[ts], F.col(ts)) <= horizon_seconds
    return found.withColumn("start", F.when(near, F.col("__attack")[ts])).drop("__attack")


def detection_delays(alerts: DataFrame, attacks: DataFrame, horizon_seconds: float, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(by, start, delay_seconds): each attack with the time to its first alert within the horizon and before the next attack of the same `by`; null where none came."""
    by = by or []
    first = matched_alerts(alerts, attacks, horizon_seconds, by, ts).where("start is not null").groupBy(*by, "start").agg(F.min(ts).alias("__first"))
    starts = attacks.select(*by, F.col(ts).alias("start")).distinct()
    return starts.join(first, [*by, "start"], "left").select(*by, "start", _seconds(F.col("start"), F.col("__first")).alias("delay_seconds"))


def false_alert_rate(alerts: DataFrame, attacks: DataFrame, horizon_seconds: float, hours: float | None = None, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """One row: alerts, false_alerts (those of no attack), per_hour. Without `hours` the time between first and last alert counts; per_hour is null if that is none."""
    found = matched_alerts(alerts, attacks, horizon_seconds, by, ts)
    span = F.lit(float(hours)) if hours else _seconds(F.min(ts), F.max(ts)) / 3600
    wrong = F.count_if(F.col("start").isNull())
    return found.agg(F.count("*").alias("alerts"), wrong.alias("false_alerts"), F.when(span > 0, wrong / span).alias("per_hour"))
