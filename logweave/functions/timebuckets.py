"""Time windows aligned to the clock or to the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_bucket(ts: Column, minutes: int) -> Column:
    """Start of the window of `minutes` that `ts` is in. Windows begin anew each hour, so the last is shorter if minutes don't divide 60."""
    return F.timestamp_add("MINUTE", (F.floor(F.minute(ts) / minutes) * minutes).cast("int"), F.date_trunc("hour", ts))


def clock_bucket_end(start: Column, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes), start)


def epoch_buckets(seconds: Column) -> tuple[Column, Column]:
    """(micro, macro): numbers of the 5- and 30-minute windows since the epoch."""
    return F.floor(seconds / 300).cast("long"), F.floor(seconds / 1800).cast("long")
