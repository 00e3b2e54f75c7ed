"""Line dedup over levelled sorted runs of line hashes. DataFrame and SQL functions only.

A run holds, for the lines of one or more batches, how many documents have each. Runs are bucketed
by the line's hash and sorted, so joins between them merge bucket with bucket and move nothing. A
new batch counts its own lines, drops by anti-join those that some run already holds as frequent,
and adds the rest as a run of level 0. When a level has `fanout` runs, they're merged into one of
the next level. So a line is rewritten a logarithmic number of times, and old batches are never
read again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.words import ascii_lower, stripped
from logweave.operators.pinning import new_table_path, pin, pin_table, remove_path

KEY = ["h1", "h2"]
#: Frequent lines that go with a plan as a list, 33 bytes each.
MAX_LISTED = 4096


def line_key(line: Column) -> Column:
    """What makes lines equal: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(stripped(line))


def _lines(text: str | Column) -> Column:
    return F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "\n")


def _hashes(key: str | Column) -> list[Column]:
    """128 bits in two longs: the second hash starts from the hash of a constant."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_counts(docs: DataFrame, text: str | Column = "text", batch: Column | None = None, min_chars: int = 1) -> DataFrame:
    """(batch, h1, h2, n_docs): in how many rows of `docs` each line key of at least `min_chars` code points is."""
    keys = docs.select((F.lit(0) if batch is None else batch).cast("int").alias("batch"), F.explode(F.array_distinct(F.transform(_lines(text), line_key))).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("batch", *_hashes("key")).groupBy("batch", *KEY).agg(F.count("*").alias("n_docs"))


@dataclass
class LineRuns:
    """The runs, by level, and how to add to them. Tables lie in the cluster's shared folder."""

    spark: SparkSession
    min_docs: int
    fanout: int = 2
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def _write(self, run: DataFrame) -> str:
        n = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_table_path(self.spark, name)
        run.select(*KEY, "n_docs").repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        """Drops a run with its files, which a table at a path of its own would leave."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Adds a batch: one row (h1, h2, n_docs) for each line key in it."""
        for run in self.runs():  # what is known to be frequent needs no more counting
            counts = counts.join(run.where(F.col("n_docs") >= self.min_docs), KEY, "left_anti")
        self._put(0, self._write(counts))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(full := self.levels[level]) == self.fanout:
            merged = self._write(self._summed([self.spark.table(n) for n in full]))
            self.levels[level] = []
            for n in full:
                self._drop(n)
            self._put(level + 1, merged)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        """The runs merged: an outer join of sorted buckets, counts added. (A union and a group would shuffle.)"""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.withColumnRenamed("n_docs", "n_a").join(b.withColumnRenamed("n_docs", "n_b"), KEY, "full_outer")
            return both.select(*KEY, (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_docs"))

        return reduce(merge, runs)

    def frequent(self) -> DataFrame:
        """(h1, h2) of lines in at least min_docs documents of all batches, as a table of known size."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return pin_table(self._summed(self.runs()).where(F.col("n_docs") >= self.min_docs).select(*KEY), "frequent_lines")

    def close(self) -> None:
        """Drops every run there is, also one that a failed batch left behind."""
        for n in [*self.paths]:
            self._drop(n)
        self.levels = []


def frequent_lines(docs: DataFrame, min_docs: int, text: str | Column = "text", id_col: str = "doc_id", batches: int = 4, min_chars: int = 1) -> DataFrame:
    """(h1, h2) of the frequent lines of a table taken as `batches` batches, which are counted in one scan."""
    runs = LineRuns(docs.sparkSession, min_docs)
    counts = pin_table(line_counts(docs, text, F.pmod(F.xxhash64(id_col), F.lit(batches)), min_chars), "line_counts")
    try:
        for b in range(batches):
            runs.add(counts.where(F.col("batch") == b))
        return runs.frequent()
    finally:
        runs.close()


def _by_list(docs: DataFrame, frequent: DataFrame, text: str, min_chars: int) -> DataFrame:
    """Adds __drop, the places of frequent lines, where these are few enough for a list in the plan: no shuffle."""
    name = lambda h1, h2: F.concat(F.hex(h1), F.lit("-"), F.hex(h2))
    listed = [r[0] for r in frequent.select(name(F.col("h1"), F.col("h2"))).collect()]
    gone = lambda key: (F.length(key) >= min_chars) & name(*_hashes(key)).isin(listed)
    keys = F.transform(_lines(text), line_key)
    return docs.withColumn("__drop", F.filter(F.transform(keys, lambda k, i: F.when(gone(k), i)), lambda i: i.isNotNull()) if listed else F.array().cast("array<int>"))


def _by_shuffle(docs: DataFrame, frequent: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """Adds __drop through joins: lines meet the frequent ones by hash, then texts their places by id and text."""
    row = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), F.posexplode(F.transform(_lines(text), line_key)).alias("__at", "key")).where(F.length("key") >= min_chars)
    hits = row.select("__id", "__text", "__at", *_hashes("key")).join(frequent, KEY, "left_semi")
    drops = pin(hits.groupBy("__id", "__text").agg(F.collect_set("__at").alias("__drop")))  # at most one document's lines
    both = docs.withColumn("__hash", F.xxhash64(text)).join(drops.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")), "left")
    return both.drop("__hash", "__id", "__text")


def line_dedup(docs: DataFrame, min_docs: int = 10, text: str = "text", id_col: str = "doc_id", batches: int = 4, min_chars: int = 1, max_listed: int = MAX_LISTED) -> DataFrame:
    """`docs` without the lines whose key is in at least `min_docs` rows; such a line goes everywhere.

    Adds n_lines, n_dropped and kept_text; columns of `docs` that have these names are replaced. A
    null or empty text is one empty line. Each row counts as a document, repeated ones too. Ids may
    be null or repeat: what is dropped from a row hangs on its text. No rows are lost.

    Up to `max_listed` frequent lines, which a count checks, go with the plan, and texts stay where they
    are; with more, texts are shuffled to meet the places of theirs. Results are the same.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    frequent = frequent_lines(docs, min_docs, text, id_col, batches, min_chars)
    both = _by_list(docs, frequent, text, min_chars) if frequent.limit(max_listed + 1).count() <= max_listed else _by_shuffle(docs, frequent, text, id_col, min_chars)
    split = both.withColumn("__lines", _lines(text)).withColumn("n_lines", F.size("__lines").cast("long"))
    split = split.withColumn("n_dropped", F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text), F.lit(""))).when(F.col("n_dropped") == F.col("n_lines"), "").otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    return split.withColumn("kept_text", kept).drop("__drop", "__lines")
