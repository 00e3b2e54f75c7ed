"""A miner of message templates: messages join clusters of similar ones in their order of arrival.

A message meets the clusters of as many words and the same first one (a word with a digit or a
placeholder is any). It joins the oldest of them that has at least a share of its words in place,
and words in which they differ become `<*>`; else it founds a cluster. Clusters are found by words
in place: as a similar one must share one of the message's rarest places, only clusters that have
one of these are compared. With a bound on clusters, a bucket forgets the one used longest ago.

The order counts, so a bucket is one sequence. Its rows flow by in that order and only its clusters are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.text import mask, squeezed

ANY = "<*>"
TURN = 8192  # messages that are rows at a time
FEW = 8  # clusters of a bucket that are all compared
RESULT = "id string, bucket string, cluster bigint, template string, change string, size bigint"


class Bucket:
    """Clusters of one bucket: words, size and last use of each, and, once there are more than FEW, which have a word in a place."""

    def __init__(self, threshold: float, most: int = 0):
        self.threshold, self.most = threshold, most
        self.clusters: dict[int, list] = {}  # number -> [words, size], least recently used first
        self.places: list[dict[str, set[int]]] = []  # by place: word -> numbers; empty while there are few clusters
        self.next = 0

    def restore(self, clusters: list[tuple[int, list[str], int]], number: int) -> None:
        """Takes over clusters (number, words, size), least recently used first."""
        self.next = number
        for n, words, size in clusters:
            self._put(n, list(words), size)

    def _put(self, n: int, words: list[str], size: int) -> None:
        self.clusters[n] = [words, size]
        if self.places:
            self._enter(n, words)
        elif len(self.clusters) > FEW:
            self.places = [{} for _ in words]
            for m, (held, _) in self.clusters.items():
                self._enter(m, held)

    def _enter(self, n: int, words: list[str]) -> None:
        for own, word in zip(self.places, words, strict=True):
            if word in own:
                own[word].add(n)
            else:
                own[word] = {n}

    def _leave(self, n: int, i: int, word: str) -> None:
        own = self.places[i][word]
        own.discard(n)
        if not own:
            del self.places[i][word]

    def similar(self, words: list[str]) -> int | None:
        """The oldest cluster with enough of the words in place."""
        need = math.ceil(self.threshold * max(1, len(words)) - 1e-9)
        if need <= 0:
            return min(self.clusters, default=None)
        known = self.clusters
        if self.places:
            held = sorted((s for s in map(dict.get, self.places, words) if s), key=len)
            known = set().union(*held[: len(held) - need + 1]) if len(held) >= need else ()
        return next((n for n in sorted(known) if sum(map(eq, self.clusters[n][0], words)) >= need), None)

    def add(self, words: list[str], weight: int = 1) -> tuple[int, str]:
        """Number of the message's cluster, and what happened to it: created, changed or none."""
        n = self.similar(words)
        if n is None:
            n, self.next = self.next, self.next + 1
            self._put(n, words, weight)
            if self.most and len(self.clusters) > self.most:
                old = next(iter(self.clusters))
                gone = self.clusters.pop(old)[0]
                if self.places:
                    for i, word in enumerate(gone):
                        self._leave(old, i, word)
            return n, "created"
        cluster = self.clusters.pop(n)
        self.clusters[n] = cluster  # now the most recently used
        cluster[1] += weight
        differ = [] if cluster[0] == words else [i for i, (a, b) in enumerate(zip(cluster[0], words, strict=True)) if a != b and a != ANY]
        for i in differ:
            if self.places:
                self._leave(n, i, cluster[0][i])
                self.places[i].setdefault(ANY, set()).add(n)
            cluster[0][i] = ANY
        return n, "changed" if differ else "none"


def bucket_of(words: Column) -> Column:
    """Number of words and the first one."""
    first = F.get(words, F.lit(0))
    return F.concat_ws("|", F.size(words), F.when(F.regexp_like(first, F.lit(r"\d|<")), ANY).otherwise(first))


def _messages(messages: DataFrame, text: str, order: list[str], id_col: str) -> DataFrame:
    """(bucket, words, id, place) of messages; words are one string, each a space apart, as an array of them takes several times the room."""
    words = squeezed(mask(F.coalesce(F.col(text), F.lit(""))))
    return messages.select(words.alias("words"), F.col(id_col).cast("string").alias("id"), F.struct(*order).alias("place")).select(bucket_of(F.split("words", " ")).alias("bucket"), "words", "id", "place")


def in_order(rows: DataFrame, by: list[str], names: list[str], run, schema: str) -> DataFrame:
    """Rows of each bucket through `run`, a function of an iterator over the columns `names` as tuples that gives tuples as in `schema`, in the order of `by`."""

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = run(r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
        while out := list(islice(each, TURN)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    kind = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (f.strip().split(" ") for f in schema.split(","))])
    return rows.repartition("bucket").sortWithinPartitions("bucket", *by).select(*names).mapInArrow(flow, schema)


def mine_templates(messages: DataFrame, order: list[str], text: str = "message", id_col: str = "record_id", threshold: float = 0.4, max_clusters: int = 0) -> DataFrame:
    """RESULT: of each message the cluster it joined in the order of `order`, whose ties go by id, with the template and size from then on.

    A cluster is a number within its bucket. `max_clusters` bounds the clusters a bucket remembers, 0 doesn't. Null texts are empty ones.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, bucket = None, Bucket(threshold, max_clusters)
        for key, words, name in rows:
            if key != now:
                now, bucket = key, Bucket(threshold, max_clusters)
            n, change = bucket.add(words.split(" "))
            held, size = bucket.clusters[n]
            yield name, key, n, " ".join(held), change, size

    return in_order(_messages(messages, text, order, id_col), ["place", "id"], ["bucket", "words", "id"], run, RESULT)


def packed(rows: Iterator[pd.DataFrame], order: list[str]) -> pa.Table:
    """A bucket's messages of a micro-batch (words, id, `order`) as Arrow columns: some tens of bytes a row, equal words once, as all must be there to be put in order."""
    tables = []
    for r in rows:
        t = pa.Table.from_pandas(r[["words", "id", *order]], preserve_index=False)
        tables.append(t.set_column(0, "words", t["words"].cast(pa.string()).dictionary_encode()))
    return pa.concat_tables(tables, promote_options="permissive").unify_dictionaries().combine_chunks()


class _Mined(StatefulProcessor):
    """The clusters of a bucket between micro-batches."""

    def __init__(self, threshold: float, most: int, order: list[str]):
        self.threshold, self.most, self.order = threshold, most, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getListState("clusters", "number long, words array<string>, size long")
        self.next = handle.getValueState("next", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bucket = Bucket(self.threshold, self.most)
        if self.next.exists():
            bucket.restore([(n, list(w), s) for n, w, s in self.clusters.get()], self.next.get()[0])
        come = packed(rows, self.order)
        places = pc.sort_indices(come, sort_keys=[(c, "ascending") for c in (*self.order, "id")], null_placement="at_start")
        for at in range(0, come.num_rows, TURN):
            out, part = [], come.select(["id", "words"]).take(places.slice(at, TURN))
            for name, text in zip(part["id"].to_pylist(), part["words"].to_pylist(), strict=True):
                n, change = bucket.add(text.split(" "))
                out.append((name, key[0], n, " ".join(bucket.clusters[n][0]), change, bucket.clusters[n][1]))
            if at + TURN >= come.num_rows:
                self.next.update((bucket.next,))
                self.clusters.put([(n, w, s) for n, (w, s) in bucket.clusters.items()])
            yield pd.DataFrame(out, columns=["id", "bucket", "cluster", "template", "change", "size"])

    def close(self) -> None:
        pass


def mine_stream(messages: DataFrame, order: list[str], text: str = "message", id_col: str = "record_id", threshold: float = 0.4, max_clusters: int = 1000) -> DataFrame:
    """As mine_templates, over a stream: each micro-batch goes on, in its own order, from where the one before left. State is `max_clusters` clusters a bucket.

    Needs the RocksDB state store.
    """
    found = _messages(messages, text, order, id_col)
    places = [f"place{i}" for i in range(len(order))]
    flat = found.select("bucket", "words", "id", *[F.col("place")[c].alias(n) for c, n in zip(found.schema["place"].dataType.names, places, strict=True)])
    return flat.groupBy("bucket").transformWithStateInPandas(_Mined(threshold, max_clusters, places), RESULT, "Append", "None")
