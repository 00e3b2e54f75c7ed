"""Campaigns that persist over runs: windows join, merge and leave them batch by batch.

Kept in one folder: the windows' anchors and their links, both by day, and which campaign each live
window is in. A window lives for `keep_seconds` behind the latest window seen; a link lives as long as
its earlier window. A batch

- links its windows to their anchors' neighbours in time, of which it reads the days within the gap;
- joins campaigns through those links, as components of campaigns and not of windows;
- and where windows expire, recomputes only campaigns that held one, from links of the days these span.

So what a batch leaves is what a computation over all live windows at once gives, as a test checks,
and no batch reads all links. A campaign is known by its smallest live window.

Each batch writes folders with its number, and last of all its commit. What isn't committed isn't
read, so a batch that was cut off is written again, and one that is repeated changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.components import components
from logweave.operators.links import MEDIUM, STRONG
from logweave.operators.pinning import pin_table, scratch

ENTITIES = "window_id string, window_start timestamp, entity_type string, value string, batch long, day date"
LINKS = "source_window string, target_window string, source_start timestamp, target_start timestamp, batch long, day date"
MEMBERS = "window_id string, window_start timestamp, root string"
DECISIONS = "kind string, campaign string, becomes string, batch long"
COMMITS = "batch long, latest timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass
class CampaignStore:
    """The store in `folder`, which all executors share."""

    spark: SparkSession
    folder: str
    max_gap_seconds: float
    keep_seconds: float

    def _table(self, name: str, schema: str, before: int) -> DataFrame:
        """What batches before this one left, whole rows of earlier days unread where a filter on day says so."""
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path).where(F.col("batch") < before) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def committed(self) -> tuple[int, object]:
        """Number and latest window start of the last committed batch; -1 and None before the first."""
        path = f"{self.folder}/commits"
        row = self.spark.read.schema(COMMITS).parquet(f"{path}/*").orderBy(F.desc("batch")).first() if _exists(self.spark, path) else None
        return (row.batch, row.latest) if row else (-1, None)

    def members(self, batch: int | None = None) -> DataFrame:
        """(window_id, window_start, root) of the live windows after a batch, by default the last committed one."""
        batch = self.committed()[0] if batch is None else batch
        return self.spark.read.schema(MEMBERS).parquet(f"{self.folder}/members/{batch}") if batch >= 0 else self.spark.createDataFrame([], MEMBERS)

    def queues(self) -> DataFrame:
        """(root, window_ids) of campaigns of two and more live windows."""
        return self.members().groupBy("root").agg(F.sort_array(F.collect_set("window_id")).alias("window_ids")).where(F.size("window_ids") > 1)

    def decisions(self) -> DataFrame:
        """(kind, campaign, becomes, batch): each merge of a campaign into another, each split into several, each end."""
        return self._table("decisions", DECISIONS, self.committed()[0] + 1)

    def update(self, entities: DataFrame, batch: int) -> None:
        """Adds a batch of (window_id, window_start, entity_type, value). Windows that are too old already are left out, known ones add nothing.

        Windows without an id or a time are left out too; addresses link nothing, but their windows' times count.
        """
        done, latest = self.committed()
        if batch > done:
            with scratch(self.spark):
                self._update(entities, batch, latest)

    def _update(self, entities: DataFrame, batch: int, before) -> None:
        day = lambda c: F.to_date(c).alias("day")
        came = entities.select("window_id", F.col("window_start").cast("timestamp").alias("window_start"), "entity_type", "value")
        came = pin_table(came.where(F.col("window_id").isNotNull() & F.col("window_start").isNotNull()).distinct(), "campaign_windows")
        span = came.agg(F.min("window_start"), F.max("window_start")).first()
        latest = max((t for t in (before, span[1]) if t is not None), default=None)
        since = lambda at, s: F.lit(at) - F.make_dt_interval(secs=F.lit(float(s)))
        cutoff = since(latest, self.keep_seconds) if latest else F.lit(None).cast("timestamp")
        live = came.where((F.col("window_start") >= cutoff) & F.col("entity_type").isin(*STRONG, *MEDIUM))

        links = self._linked(live, span, cutoff, batch)
        self._write(links.withColumn("day", day("source_start")), "links", batch, "day")
        links = self.spark.read.schema(LINKS.replace(", batch long", "")).option("basePath", f"{self.folder}/links/batch={batch}").parquet(f"{self.folder}/links/batch={batch}")
        old = self.members(batch - 1) if batch and _exists(self.spark, f"{self.folder}/members/{batch - 1}") else self.members()
        merged, moved = self._merged(old, live, links)
        left, split = self._expired(merged, before, cutoff, batch) if before else (merged, self.spark.createDataFrame([], "campaign string, becomes string"))

        self._write(live.withColumn("day", day("window_start")), "entities", batch, "day")
        left.select("window_id", "window_start", "root").write.mode("overwrite").parquet(f"{self.folder}/members/{batch}")
        told = moved.select(F.lit("merge").alias("kind"), "campaign", "becomes").unionByName(split.select(F.when(F.col("becomes").isNull(), "end").otherwise("split").alias("kind"), "campaign", "becomes"))
        self._write(told, "decisions", batch)
        self.spark.createDataFrame([(batch, latest)], COMMITS).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")

    def _write(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}/batch={batch}")

    def _linked(self, live: DataFrame, span, cutoff, batch: int) -> DataFrame:
        """Links of new windows to the neighbours in time that their anchors have."""
        stored = self._table("entities", ENTITIES, batch)
        if span[0] is not None:
            gap = F.make_dt_interval(secs=F.lit(float(self.max_gap_seconds)))
            near = (F.col("day") >= F.to_date(F.lit(span[0]) - gap)) & (F.col("day") <= F.to_date(F.lit(span[1]) + gap))
            stored = stored.where(near & (F.col("window_start") >= cutoff)).join(live.select("entity_type", "value").distinct(), ["entity_type", "value"], "left_semi")
        both = stored.select("window_id", "window_start", "entity_type", "value", F.lit(False).alias("new")).unionByName(live.withColumn("new", F.lit(True)))
        both = both.groupBy("window_id", "window_start", "entity_type", "value").agg(F.min("new").alias("new"))
        order = W.partitionBy("entity_type", "value").orderBy("window_start", "window_id")
        prior = lambda c: F.lag(c).over(order)
        pairs = both.select(prior("window_id").alias("source_window"), F.col("window_id").alias("target_window"), prior("window_start").alias("source_start"), F.col("window_start").alias("target_start"), (F.col("new") | prior("new")).alias("new"))
        fits = F.col("target_start").cast("double") - F.col("source_start").cast("double") <= self.max_gap_seconds
        return pairs.where(F.col("new") & fits).drop("new").distinct()

    def _merged(self, old: DataFrame, live: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with the batch's windows, its links between campaigns applied, and (campaign, becomes) of old campaigns that changed."""
        alone = live.select("window_id", "window_start").distinct().join(old, "window_id", "left_anti").withColumn("root", F.col("window_id"))
        now = pin_table(old.select("window_id", "window_start", "root").unionByName(alone), "campaign_members")
        side = lambda c, root: now.select(F.col("window_id").alias(c), F.col("root").alias(root))
        between = links.join(side("source_window", "a"), "source_window").join(side("target_window", "b"), "target_window").where("a <> b").select("a", "b").distinct()
        moved = pin_table(components(between, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("to")), "campaign_moves")
        merged = now.join(moved, "root", "left").select("window_id", "window_start", F.coalesce("to", "root").alias("root"))
        return merged, moved.join(old.select("root").distinct(), "root", "left_semi").select(F.col("root").alias("campaign"), F.col("to").alias("becomes"))

    def _expired(self, merged: DataFrame, before, cutoff, batch: int) -> tuple[DataFrame, DataFrame]:
        """Members without the windows that expire, campaigns that held one recomputed, and what became of these."""
        merged = pin_table(merged, "campaign_merged")
        gone = merged.where(F.col("window_start") < cutoff)
        held = pin_table(gone.select("root").distinct(), "campaigns_with_expired")
        if held.isEmpty():
            return merged, self.spark.createDataFrame([], "campaign string, becomes string")
        stay = pin_table(merged.join(held, "root", "left_semi").where(F.col("window_start") >= cutoff), "campaigns_left")
        last = stay.agg(F.max("window_start")).first()[0]
        if last is None:
            found = self.spark.createDataFrame([], "window_id string, to string")
        else:
            links = self._table("links", LINKS, batch + 1).where((F.col("day") >= F.to_date(cutoff)) & (F.col("day") <= F.to_date(F.lit(last))) & (F.col("source_start") >= cutoff))
            links = links.join(stay.select(F.col("window_id").alias("source_window")), "source_window", "left_semi")
            found = components(links, "source_window", "target_window").select(F.col("node").alias("window_id"), F.col("root").alias("to"))
        again = pin_table(stay.join(found, "window_id", "left").select("window_id", "window_start", F.col("root").alias("was"), F.coalesce("to", "window_id").alias("root")), "campaigns_again")
        parts = again.groupBy("was").agg(F.collect_set("root").alias("roots"))
        split = held.join(parts, held.root == parts.was, "left").select(F.col("root").alias("campaign"), F.explode_outer("roots").alias("becomes"))
        return merged.join(held, "root", "left_anti").select("window_id", "window_start", "root").unionByName(again.select("window_id", "window_start", "root")), split.where(F.col("becomes").isNull() | (F.col("becomes") != F.col("campaign")))
