"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step points every neighbour at the smallest node its centre knows, so the edges turn into
stars around the smallest node of each component in about log² rounds, whatever the diameter.
Whether they are stars already is one aggregate, of which a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.pinning import pin


def _toward_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each (a, b) becomes (b, least of a). `least` is pinned, so that a hot centre is a skewed join, which AQE splits."""
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pin(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")))
    return pin(_toward_least(both.where("b > a"), least).unionByName(least.where("least < a").select("a", F.col("least").alias("b"))).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = pin(edges.groupBy("a").agg(F.min("b").alias("least")))
    return pin(_toward_least(edges, least).unionByName(least.select("a", F.col("least").alias("b"))).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node points at two others, and none that points at one is pointed at. As a > b, a star's centre is its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of `edges` that is not its own root; root is the component's smallest node.

    Nodes may be of any orderable type. Self-loops, repeated edges and edges with a null end
    join nothing. Nodes without an edge, and the roots themselves, are not in the result.
    """
    ends = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), F.col(src).isNotNull() & F.col(dst).isNotNull())
    now = pin(ends.where(ends[2]).select("a", "b").where("a > b").distinct())
    while not _are_stars(now):
        now = _small_star(_large_star(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
