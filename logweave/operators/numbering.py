"""Dense global positions without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.pinning import pin_table


def dense_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Adds `name`, the 0-based place of each row in `order` over all rows.

    Rows are range-partitioned and numbered in their partition; partitions' row counts, one row
    for each, then shift them. Ties get different places in an unspecified order. Nulls come first,
    as in Spark's sort. No row goes through a single task.
    """
    made = {f"__o{i}": c for i, c in enumerate(order) if isinstance(c, Column)}
    keys = [f"__o{i}" if isinstance(c, Column) else c for i, c in enumerate(order)]
    # sorted where they were dealt to: an id is the partition's number, times 2^33, and the place in it, so rows are moved once
    dealt = df.select("*", *[c.alias(n) for n, c in made.items()]).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = pin_table(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__id", 33))
    offsets = dealt.groupBy("__part").count().withColumn("__offset", F.sum("count").over(W.orderBy("__part")) - F.col("count")).drop("count")
    here = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, here + F.col("__offset")).drop("__part", "__id", "__offset", *made)
