"""SimHash near-duplicates, found with BK-trees of fingerprint shards.

Fingerprints are dealt to shards by blocks of equal bits: cut the bits into radius + 1 blocks, and
two fingerprints within the radius agree on a whole block. A shard with too many members is dealt
again by blocks of the bits that its members may still differ in, until every shard is small; that
ends, as each turn takes a third of those bits. Each shard is one BK-tree: children are keyed by
their integer Hamming distance to the parent, and a search follows only the edges within the radius.

Trees aren't broadcast: all of them together grow with the corpus. Each is built in the task that
holds its shard, whose size has a fixed bound, and every fingerprint is brought to the few shards
that can hold its neighbours. Only links that join a shard's groups leave it, at most one a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.operators.components import components
from logweave.operators.pinning import pin, pin_table

BITS = 64
SHARD_LIMIT = 256


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of lower-cased (A-Z) word shingles: a bit is set if over half of the shingles' hashes have it."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else (b" ".join(w),)
    h = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # in blocks, for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str | Column = "doc_id", text: str | Column = "text", shingle: int = 3, seed: int = 42, also: Column | None = None) -> DataFrame:
    """(doc_id, fp, and the long `also`, if given): the fingerprint's 64 bits as a long. Texts without words, null ones too, have fingerprint 0."""
    own = [(id_col if isinstance(id_col, Column) else F.col(id_col)).cast("long").alias("doc_id")] + ([] if also is None else [also])
    base = docs.select((text if isinstance(text, Column) else F.col(text)).cast("string").alias("__text"), *own)
    names = [f.name for f in base.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = np.fromiter((fingerprint(t, shingle, seed) for t in utf8(b.column(0))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found.view(np.int64))], [*names, "fp"])

    return base.mapInArrow(run, ", ".join([f"`{n}` bigint" for n in [*names, "fp"]]))


class BKTree:
    """A tree over integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Adds `value`; its number, or the number it already has."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at a distance of at most `radius`."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:  # a child at distance e of this node holds values at distances d - e to d + e
                todo += [edges[e] for e in range(max(1, d - radius), d + radius + 1) if e in edges]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its group) for values of one shard that links of at most `radius` bits join."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for v in values:
        near = tree.within(v, radius)
        i = tree.add(v)
        if i == len(parent):
            parent.append(i)
        for j in near:
            a, b = root(i), root(j)
            if a != b:
                a, b = (a, b) if tree.values[a] < tree.values[b] else (b, a)
                parent[b] = a
    return [(v, tree.values[r]) for i, v in enumerate(tree.values) if (r := root(i)) != i]


def _cut(mask: int, parts: int) -> list[int]:
    """`mask` grown by each of `parts` blocks of the bits that it lacks."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(free[len(free) * k // parts : len(free) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int = 2, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints (column fp, each once, pinned) that chains of links within `radius` bits connect."""
    masks = _cut(0, radius + 1)
    members = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks])).alias("s")).select("fp", "s.*")
    links = None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = b.column(0).flatten().to_numpy().view(np.uint64).tolist(), np.cumsum(b.column(0).value_lengths().to_numpy()).tolist()
            pairs = [p for start, end in zip([0, *ends], ends) for p in tree_links(values[start:end], radius)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array(np.array([p[i] for p in pairs], np.uint64).view(np.int64)) for i in (0, 1)], ["src", "dst"])

    while True:
        sizes = pin(members.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        shared = members.join(sizes, ["mask", "bits"])
        if most > shard_limit:
            shared = pin(shared)
        shards = shared.where(F.col("n") <= shard_limit).groupBy("mask", "bits").agg(F.collect_list("fp").alias("shard")).select("shard")
        found = shards.mapInArrow(search, "src bigint, dst bigint")
        links = found if links is None else links.unionByName(found)
        if most <= shard_limit:
            return links
        by_mask = {m: _cut(m, radius + 1) for m in masks}
        masks = sorted({c for cs in by_mask.values() for c in cs})
        children = F.create_map(*[x for m, cs in by_mask.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cs]))])
        members = shared.where(F.col("n") > shard_limit).select("fp", F.explode(children[F.col("mask")]).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")).distinct()


def _grouped(by_doc: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, first_fp) from pinned (doc_id, fp): of each component the smallest doc_id, and the smallest fingerprint that has it.

    A component without any doc_id has a null one, and the smallest of its fingerprints.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    distinct = pin(by_doc.groupBy("fp").agg(first.alias("least")))
    roots = pin(components(near_links(distinct.select("fp"), radius)))
    rooted = pin(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    best = pin(rooted.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("best")))
    return pin(rooted.join(best, "root").select("fp", F.col("best.least.doc_id").alias("component_id"), F.col("best.fp").alias("first_fp")))


def simhash_groups(docs: DataFrame, id_col: str | Column = "doc_id", text: str | Column = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """For every row of `docs`: doc_id, fp, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links), kept (doc_id is component_id).

    Null, empty and word-less texts have fingerprint 0 and link like any other. Rows with a null
    doc_id get their component's id, null if no row of it has one, and aren't kept. Repeated rows
    and ids stay, one result row each. An empty table gives an empty result. Other columns of
    `docs`, whatever their names, play no part.
    """
    by_doc = pin(fingerprints(docs, id_col, text, shingle, seed))
    return by_doc.join(_grouped(by_doc, radius), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def text_hash(text: str) -> Column:
    """What stands for a text, beside its row's id, so that a row is found again without its text."""
    return F.xxhash64(F.col(text).cast("string"))


#: Rows of keys, of 17 bytes each, that are broadcast to wide rows rather than shuffled with them.
MAX_BROADCAST = 1 << 19


def counted_broadcast(keys: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """`keys`, pinned and narrow, to be broadcast if a count says that they are at most `most` rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def kept_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of `docs` whose id and text are in `kept` (id, hash), one of those that repeat with both.

    `rows` (id, hash) has all of them, pinned. What goes is usually little: it is broadcast if a count says
    so, and texts stay where they are; beyond that, rows meet it by their hash.
    """
    same = lambda a, b: a["__id"].eqNullSafe(b["id"]) & (a["__hash"] == b["hash"])
    chosen = kept.select(F.col("id").alias("__kid"), F.col("hash").alias("__khash"))
    counted = rows.groupBy("id", "hash").agg(F.count("*").alias("n"))
    decided = counted.join(chosen, F.col("id").eqNullSafe(F.col("__kid")) & (F.col("hash") == F.col("__khash")), "left").select("id", "hash", "n", F.col("__khash").isNotNull().alias("keep"))
    special = pin_table(decided.where("not keep or n > 1"), "not_once")
    own = docs.select("*", F.col(id_col).cast("long").alias("__id"), text_hash(text).alias("__hash"))
    out = own.join(counted_broadcast(special), same(own, special), "left_anti")
    repeated = special.where("keep")
    if not repeated.isEmpty():
        out = out.unionByName(own.join(counted_broadcast(repeated), same(own, repeated), "left_semi").dropDuplicates(["__id", "__hash"]))
    return out.drop("__id", "__hash")


def near_distinct(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row of `docs` from each group of near-duplicates: one with the smallest doc_id.

    Where rows share that id and the group, which of them stays is settled by their fingerprints and
    texts' hashes, then arbitrary. Groups whose rows have no id keep one too. Null and empty texts are one group.
    """
    hashed = pin(fingerprints(docs, id_col, text, shingle, seed, also=text_hash(text).alias("hash")).withColumnRenamed("doc_id", "id"))
    best = _grouped(hashed.withColumnRenamed("id", "doc_id"), radius).where("fp = first_fp").select(F.col("component_id").alias("__best"), F.col("fp").alias("__fp"))
    found = hashed.join(best, (F.col("fp") == F.col("__fp")) & F.col("id").eqNullSafe(F.col("__best")))
    return kept_rows(docs, hashed.select("id", "hash"), found.groupBy("__fp").agg(F.min(F.struct("hash", "id")).alias("one")).select("one.id", "one.hash"), id_col, text)
