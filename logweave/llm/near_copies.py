"""Near copies by exact Jaccard similarity of word shingles, found through SimHash BK-trees.

At a similarity of 0.8 fingerprints of 64 bits differ in about ten, so blocks of equal bits no longer
part the corpus into small shards. Shards are dealt by bands of min-hashes instead: two documents
with similarity s share one of 20 bands of 5 with probability 1 - (1 - s**5)**20, 0.9996 at 0.8. A
shard is a BK-tree over SimHash fingerprints, searched with a wide radius, which passes over what is
merely in the same shard. Each pair it gives is verified by the exact similarity of shingle sets.

Equal sets are one node from the start. Each round joins verified pairs and goes on with one node of
each group, the one with most links, until no pair among those left is verified. First each shard
compares its members with its centre alone, the one nearest to the majority of its bits: a tree with
that root, of which the edges within the radius are the pairs. So a group of near copies, however
large, shrinks at linear cost, and no task holds a shard. While that joins any, it is done again; shards of any
size take these steps, so that what stays of a group doesn't hang on how many others there are. Then all pairs of
what is left are compared, a large shard's chunk by chunk. There
a sketch of 512 more min-hashes, a byte of each, passes over what is surely not similar enough, so
that what leaves a shard is little more than its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.llm.simhash import BITS, BKTree, counted_broadcast, kept_rows, text_hash
from logweave.operators.components import components
from logweave.operators.pinning import new_table_path, pin, pin_table, remove_path

BANDS, ROWS = 20, 5
RADIUS = 22
#: Members of a shard that are compared in one task, and bytes of a sketch.
SHARD_LIMIT, SKETCH = 1024, 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words met before; forgotten when they are many, so that the memory has a bound."""

    def __init__(self, seed: int, most: int = 1 << 17):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


_hashes = lru_cache(maxsize=2)(_WordHashes)


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's lower-cased (A-Z) word shingles; a shorter text is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    known = _hashes(seed)
    one, span = np.fromiter((known[x] for x in w), np.uint64, len(w)), min(shingle, len(w))
    n = len(w) - span + 1
    h = one[:n]
    for k in range(1, span):
        h = _mixed(h * _ODD + one[k : n + k])
    return np.unique(h)


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit hash of a shingle set, 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) if len(hashes) else 0


def set_fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<u8")[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of min-hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        np.minimum(least, (hashes[at : at + (1 << 11)] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


@lru_cache(maxsize=1)
def _sketch_hashes() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(43)
    return draw.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte of each of SKETCH min-hashes of a set; of two sets about their Jaccard similarity of the bytes are equal."""
    times, plus = _sketch_hashes()
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512] * times[:, None] + plus[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def least_equal(similarity: float) -> int:
    """How many bytes of two sketches are equal, but for one pair in some thousands, of sets with at least this similarity."""
    return int(SKETCH * similarity - 3.5 * (SKETCH * similarity * (1 - similarity)) ** 0.5)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def shard_pairs(fps: list[int], keys: list[int], sketches: np.ndarray, radius: int, equal: int) -> list[tuple[int, int]]:
    """All pairs of `keys` whose fingerprints are within the radius and of whose sketches at least `equal` bytes are equal."""
    tree, held, out = BKTree(), [], []
    for i, fp in enumerate(fps):
        near = np.array([j for n in tree.within(fp, radius) for j in held[n]], np.int64)
        if len(near):
            near = near[(sketches[near] == sketches[i]).sum(axis=1) >= equal]
            out += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in near.tolist()]
        at = tree.add(fp)
        if at == len(held):
            held.append([])
        held[at].append(i)
    return out


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, fp, band, n) of bands that several of the pinned nodes (key, fp, bands) have, pinned."""
    members = nodes.select("key", "fp", F.explode("bands").alias("band"))
    sizes = pin_table(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band_sizes")
    return pin_table(members.join(sizes.hint("merge"), "band").select("key", "fp", "band", "n"), "shared_bands")


def _centre_pairs(shared: DataFrame, radius: int) -> DataFrame:
    """(a, b), each once: every member of a shard with the member nearest to the majority of its bits."""
    bit = lambda i: F.lit((1 << i) - (1 << 64 if i == 63 else 0))
    sums = shared.groupBy("band").agg(F.count("*").alias("of"), *[F.sum(F.bit_get("fp", F.lit(i)).cast("int")).alias(f"s{i}") for i in range(BITS)])
    majority = reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"s{i}") > F.col("of"), bit(i)).otherwise(F.lit(0)) for i in range(BITS)])
    near = shared.join(sums.select("band", majority.alias("majority")), "band")
    centres = near.groupBy("band").agg(F.min_by(F.struct(F.col("key").alias("centre"), F.col("fp").alias("centre_fp")), F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("majority"))), "key")).alias("c")).select("band", "c.*")
    found = shared.join(pin_table(centres, "band_centres"), "band").where((F.col("key") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre_fp"))) <= radius))
    return found.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()


def _all_pairs(shared: DataFrame, sketches: DataFrame, radius: int, shard_limit: int, equal: int) -> DataFrame:
    """(a, b), each once: all pairs of shards within the radius, by their sketches (key, sketch) perhaps similar."""
    chunks = F.when(F.col("n") > shard_limit, F.ceil(F.col("n") * 2 / shard_limit)).otherwise(F.lit(1)).cast("int")
    shared = shared.withColumn("of", chunks).withColumn("own", F.pmod(F.xxhash64("key", "band"), F.col("of")).cast("int"))
    # each two chunks of a shard meet
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    shards = shared.join(sketches, "key").groupBy("band", "low", "high").agg(F.collect_list(F.struct("key", "fp", "sketch")).alias("shard")).where(F.size("shard") > 1).select("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b.column(0).flatten(), np.cumsum(b.column(0).value_lengths().to_numpy()).tolist()
            keys, fps = (flat.field(i).to_numpy().view(np.uint64).tolist() for i in (0, 1))
            sketched = np.frombuffer(b"".join(flat.field(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            for start, end in zip([0, *ends], ends):  # noqa: B905
                found = shard_pairs(fps[start:end], keys[start:end], sketched[start:end], radius, equal)
                if found:
                    yield pa.RecordBatch.from_arrays([_longs([p[i] for p in found]) for i in (0, 1)], ["a", "b"])

    return shards.mapInArrow(search, "a bigint, b bigint").distinct()


class _Sets:
    """Shingle sets and sketches by key, bucketed by it once, so that no join moves them again."""

    def __init__(self, found: DataFrame):
        self.spark, self.name = found.sparkSession, f"shingle_sets_{uuid.uuid4().hex}"
        self.path = new_table_path(self.spark, self.name)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found.withColumn("n", F.size("hashes")).repartition(n, "key").write.bucketBy(n, "key").sortBy("key").option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def similar(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """The pairs (a, b) whose sets have that Jaccard similarity. The smaller set of a pair goes to the larger one."""
        sizes = self.table().select("key", "n")
        sized = pairs.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b")
        # sets further apart in size than the similarity can't have it
        sized = sized.where(F.least("x", "y") >= similarity * F.greatest("x", "y"))
        sent = sized.select("a", "b", F.when(F.col("x") <= F.col("y"), F.col("a")).otherwise(F.col("b")).alias("less"), F.when(F.col("x") <= F.col("y"), F.col("b")).otherwise(F.col("a")).alias("more"))
        own = self.table().select("key", "hashes")
        sent = sent.join(own.toDF("less", "p"), "less").hint("merge")
        both = sent.join(own.toDF("more", "q"), "more")
        common = F.size(F.array_intersect("p", "q"))
        return both.where(common / (F.size("p") + F.size("q") - common) >= similarity).select("a", "b")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


def similar_distinct(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, seed: int = 42, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row of `docs` from each group of near copies: one with the smallest doc_id.

    Near copies have shingle sets with a Jaccard similarity of at least `similarity`; of any two rows
    left none are, up to the recall of bands, radius and sketch, and every row that goes is joined to one that
    stays by such links. `shard_limit` only says how many members of a shard one task compares; no row's fate hangs on it, nor on
    rows that share no band with its group. Equal sets are told by 64-bit hashes, similarities are of sets of their upper 32 bits. Ids, ties and texts without words are as in
    `simhash.near_distinct`. Texts are hashed once, and again only those of candidate pairs.
    """
    base = docs.select(F.col(text).cast("string").alias("__text"), F.col(id_col).cast("long").alias("id"), text_hash(text).alias("hash"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t, shingle, seed) for t in utf8(b.column(0))]
            bands = [band_keys(s) for s in sets]
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _longs([k for ks in bands for k in ks]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), _longs([set_key(s) for s in sets]), _longs([set_fingerprint(s) for s in sets]), lists], ["id", "hash", "key", "fp", "bands"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t, shingle, seed) for t in utf8(b.column(0))]
            halves = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
            ends = np.cumsum([0, *map(len, halves)]).astype(np.int32)
            flat = np.concatenate([*halves, np.empty(0, np.uint32)]).view(np.int32)
            yield pa.RecordBatch.from_arrays([_longs([set_key(s) for s in sets]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([sketch(s) for s in sets], pa.binary())], ["key", "hashes", "sketch"])

    rows = pin(base.mapInArrow(describe, "id bigint, hash bigint, key bigint, fp bigint, bands array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least")
    nodes = pin(rows.groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    sets = tested = None
    around, alone = True, []
    while True:
        shared = _shared(nodes)
        # a node without a band in common has none later either, as nodes only get fewer
        meeting = pin_table(shared.select("key").distinct(), "meeting_nodes")
        alone.append(pin(nodes.join(meeting, "key", "left_anti").select("least")))
        nodes = pin(nodes.join(meeting, "key", "left_semi"))
        if sets is None:
            asked = nodes.select(F.col("least.id").alias("__id"), F.col("least.hash").alias("__hash"))
            texts = pin_table(asked, "asked_texts")
            own = base.join(counted_broadcast(texts), F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left_semi").select("__text")
            found = own.mapInArrow(whole_sets, "key bigint, hashes array<int>, sketch binary")
            # only rows that repeat with id and text give a set more than once
            repeat = rows.groupBy("id", "hash").count().where("count > 1")
            sets = _Sets(found if repeat.isEmpty() else found.dropDuplicates(["key"]))
        pairs = _centre_pairs(shared, radius) if around else _all_pairs(shared, sets.table().select("key", "sketch"), radius, shard_limit, least_equal(similarity))
        pairs = pin(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        links = pin(sets.similar(pairs, similarity))
        found = not links.isEmpty()
        if found:
            roots = pin(components(links, "a", "b")).withColumnRenamed("node", "key")
            degrees = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").count()
            rooted = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(degrees, "key", "left")
            middle = F.max_by(F.struct("key", "fp", "bands"), F.struct(F.coalesce("count", F.lit(0)), "key")).alias("middle")
            nodes = pin(rooted.groupBy("root").agg(F.min("least").alias("least"), middle).select("least", "middle.*"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found and not around:
            break
        around = around and found
    sets.drop()
    left = reduce(DataFrame.unionByName, alone, nodes.select("least"))
    return kept_rows(docs, rows.select("id", "hash"), left.select("least.id", "least.hash"), id_col, text)
