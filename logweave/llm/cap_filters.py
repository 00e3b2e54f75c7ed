"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction on the sphere and holds the vectors whose cosine to it exceeds a bar. The
directions are a structured random product code: the space is turned at random and cut into blocks,
each block has a small random code, and a direction is a choice of one code word in every block. So
all directions that a vector exceeds are found by list decoding: code words of each block, best
first, combined only while the sum can still reach the bar. Close vectors exceed common directions,
so a join on filters finds them, and the exact cosine, in double precision, verifies.

The bar follows from the number of vectors of a label, so that a filter holds a few of them on
average at any size, and the size of the code from the bar, so that a pair at the cosine bound is
expected in COMMON common filters. Labels of sizes within a factor of two share their codes. There
are a few independent ones, which evens out how well a turned vector suits its blocks. In fewer than
8 dimensions a code has one block, in one dimension the two directions there are.

Equal vectors are one node with a weight. A pair counts in one of its common filters alone: filters
have an order, those that hold most first, and the first that two vectors share is theirs. A dense
group shares its first filter, so in all others its vectors pass each other by, and a filter whose
vectors all have another first filter in common is left out. One that holds many vectors is cut into
blocks of at most TILE, and each pair of blocks is a task of its own. Links leave a tile as counts
and a spanning forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.components import components
from logweave.operators.pinning import pin, pin_table

COMMON = 20.0
PER_FILTER = 64.0
CODES = 4
MAX_WORDS = 1024
TILE = 1024
LOW_DIM = 8


def cap_share(bar: float, dim: int) -> float:
    """The share of the sphere in `dim` dimensions within cosine `bar` of a direction, by numeric integration."""
    if dim < LOW_DIM:
        return float((_directions(dim)[:, 0] >= bar).mean())
    t = np.linspace(-1, 1, 40001)
    density = (1 - t * t) ** ((dim - 3) / 2)
    return float(density[t >= bar].sum() / density.sum())


@lru_cache(maxsize=8)
def _directions(dim: int, n: int = 200_000) -> np.ndarray:
    """Random directions, to estimate shares where the formulas of many dimensions have poles."""
    d = np.random.default_rng(dim).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def wedge_share(bar: float, cosine: float, dim: int) -> float:
    """The share of directions that two vectors at `cosine` both exceed."""
    if dim < LOW_DIM:
        d = _directions(dim)
        return float(((d[:, 0] >= bar) & (cosine * d[:, 0] + math.sqrt(1 - cosine * cosine) * d[:, 1] >= bar)).mean())
    t = np.linspace(bar, 1, 2001)
    density = (1 - t * t) ** ((dim - 3) / 2)
    sine = math.sqrt(1 - cosine * cosine)
    need = (bar - cosine * t) / (sine * np.sqrt(np.maximum(1 - t * t, 1e-12)))  # of the second vector's own part
    grid = np.linspace(-1, 1, 4001)
    tail = np.cumsum(((1 - grid * grid) ** ((dim - 4) / 2))[::-1])[::-1]
    beyond = np.interp(np.clip(need, -1, 1), grid, tail / tail[0])
    beyond[need > 1] = 0
    whole = np.linspace(-1, 1, 40001)
    return float((density * beyond).sum() * (t[1] - t[0]) / (((1 - whole * whole) ** ((dim - 3) / 2)).sum() * (whole[1] - whole[0])))


def code_parameters(n: int, dim: int, cosine: float) -> tuple[float, int, int]:
    """(bar, blocks, code words in each) of each of CODES codes, for labels of up to `n` vectors in `dim` dimensions.

    The lowest bar at which a filter holds no more than PER_FILTER vectors on average, and as many
    directions as a pair at `cosine` needs to have COMMON of them in common.
    """
    if dim == 1:
        return 0.5, 1, 2
    bar = 0.2
    while cap_share(bar, dim) * n > PER_FILTER and bar < 0.8:
        bar += 0.02
    directions = COMMON / CODES / max(wedge_share(bar, cosine, dim), 1e-15)
    if dim < LOW_DIM:
        return bar, 1, max(4, math.ceil(directions))
    blocks = next(k for k in range(2, dim + 1) if directions ** (1 / k) <= MAX_WORDS)
    return bar, blocks, max(4, math.ceil(directions ** (1 / blocks)))


@lru_cache(maxsize=64)
def _code(dim: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and for each block its unit code words. The same on every executor."""
    if dim == 1:
        return np.eye(1), [np.array([[1.0], [-1.0]])]
    rng = np.random.default_rng([seed, dim, blocks, words])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    parts = [rng.standard_normal((words, len(part))) for part in np.array_split(np.arange(dim), blocks)]
    return turn, [c / np.linalg.norm(c, axis=1, keepdims=True) for c in parts]


def list_decode(units: np.ndarray, bar: float, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """For each row, a unit vector: the numbers of all directions at a cosine of at least `bar`, ascending."""
    turn, parts = _code(units.shape[1], blocks, words, seed)
    turned, need = units @ turn, bar * math.sqrt(blocks)
    edges = np.cumsum([0, *(c.shape[1] for c in parts)])
    scores = [turned[:, s:e] @ c.T for c, s, e in zip(parts, edges[:-1], edges[1:], strict=True)]
    order = [np.argsort(-s, axis=1) for s in scores]
    best = [np.take_along_axis(s, o, 1) for s, o in zip(scores, order, strict=True)]
    rest = [sum((b[:, 0] for b in best[k + 1 :]), np.zeros(len(units))) for k in range(blocks)]
    out = []
    for i in range(len(units)):
        sums, codes = np.zeros(1), np.zeros(1, np.int64)
        for k in range(blocks):
            # of the words, best first, those that can still reach the bar with the best of what follows
            ends = np.searchsorted(-best[k][i], -(need - rest[k][i] - sums), side="right")
            pick = np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
            sums, codes = np.repeat(sums, ends) + best[k][i][pick], np.repeat(codes, ends) * words + order[k][i][pick]
        out.append(np.sort(codes))
    return out


def all_filters(units: np.ndarray, bar: float, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """As list_decode, over CODES independent codes with numbers of their own."""
    each = [list_decode(units, bar, blocks, words, seed + r) for r in range(CODES)]
    return [np.concatenate([f + r * words**blocks for r, f in enumerate(own)]) for own in zip(*each, strict=True)]


def _usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components, and of a positive length."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _tile_links(a: dict, b: dict, cosine: float, same: bool, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members of blocks a and b that link, and whose first common filter is this one, of number `own`.

    Members with another first filter in common have met there: only those of different ones are compared.
    """
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    kinds = np.unique(a["first"])
    if len(a["node"]) * len(b["node"]) <= 1 << 14 or len(kinds) > 64:  # not worth a product for each first filter
        met = a["first"][:, None] == np.where(b["first"] == own, -1, b["first"])
        i, j = np.nonzero((a["unit"] @ b["unit"].T >= cosine) & ~met)
        keep = i < j if same else slice(None)
        rows, cols, kinds = [i[keep]], [j[keep]], []
    for f in kinds:
        mine = np.flatnonzero(a["first"] == f)
        others = np.arange(len(b["node"])) if f == own else np.flatnonzero(b["first"] != f)
        for start in range(0, len(mine), 256):
            part = mine[start : start + 256]
            i, j = np.nonzero(a["unit"][part] @ b["unit"][others].T >= cosine)
            i, j = part[i], others[j]
            if same:
                i, j = i[i < j], j[i < j]
            rows.append(i)
            cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if not len(i):
        return i, j
    if len(i) < 50:
        again = np.array([len(np.intersect1d(a["before"][x], b["before"][y], assume_unique=True)) > 0 for x, y in zip(i, j, strict=True)], bool)
    else:  # all at once: how many earlier filters two members share is a product of incidence matrices
        shared = np.intersect1d(np.concatenate(a["before"]), np.concatenate(b["before"]))
        again = (_incidence(a["before"], shared) @ _incidence(b["before"], shared).T > 0)[i, j]
    return i[~again], j[~again]


def _incidence(lists: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """A row for each list, with 1 at those of `values`, sorted, that it holds."""
    out = np.zeros((len(lists), len(values)), np.float32)
    for k, x in enumerate(lists):
        at = np.searchsorted(values, x)
        at, x = at[at < len(values)], x[at < len(values)]
        out[k, at[values[at] == x]] = 1
    return out


def cap_links(nodes: DataFrame, cosine: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """From pinned `nodes` (node, label, vector, weight; usable and different within a label): (node, links), (src, dst).

    `links` counts the vectors, weights included, that the node links with; the edges connect what links connect.
    """
    dims = nodes.select("node", "label", "vector", F.size("vector").alias("dim"))
    # 0, 1, 2, …: labels of up to 1, 2, 4, … vectors of a dimension
    octave = F.ceil(F.log2(F.count("*").cast("double"))).cast("int")
    sizes = pin_table(dims.groupBy("label", "dim").agg(octave.alias("size_class")), "cap_sizes")
    codes = {(r.dim, r.size_class): code_parameters(2**r.size_class, r.dim, cosine) for r in sizes.select("dim", "size_class").distinct().collect()}  # as many as dimensions and powers of two

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(1).value_lengths().to_numpy(), batch.column(2).to_numpy()])
            for dim, size_class in np.unique(kinds, axis=1).T.tolist():
                code, at = codes[dim, size_class], np.flatnonzero((kinds[0] == dim) & (kinds[1] == size_class))
                for part in np.array_split(at, 1 + len(at) * code[2] // 500_000):
                    sub = batch.take(pa.array(part))
                    found = all_filters(_units(sub.column(1)), *code, seed)
                    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([sub.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], ["node", "filters"])

    known = dims.join(sizes.where("size_class > 0"), ["label", "dim"]).select("node", "vector", "size_class")
    decoded = known.mapInArrow(filters, "node bigint, filters array<bigint>")
    key = ["label", "dim", "filter"]
    light = pin_table(decoded.join(dims.select("node", "label", "dim"), "node").select("node", "label", "dim", F.explode("filters").alias("filter")), "cap_members")
    held = pin_table(light.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "cap_held")
    # each vector's filters in their order: those that hold most first
    order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "filter"))), lambda x: x["filter"])
    ordered = pin_table(light.join(held, key).groupBy("node", "label", "dim").agg(order.alias("filters")), "cap_orders")
    placed = ordered.select("node", "label", "dim", "filters", F.get("filters", F.lit(0)).alias("first"), F.posexplode("filters").alias("at", "filter"))
    firsts = placed.groupBy(*key).agg(F.min("first").alias("low"), F.max("first").alias("high"), F.count("*").alias("n"))
    useful = pin_table(firsts.where("low <> high or low = filter").select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "cap_useful")
    member = placed.join(useful, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member of block b meets every other block, and its own, in one tile each
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    tiled = member.select(*key, "node", "block", "first", F.array_sort(F.slice("filters", 1, F.col("at"))).alias("before"), F.explode(tiles).alias("tile")).select("*", "tile.*").drop("tile")
    full = tiled.join(nodes.select("node", "vector", "weight"), "node").select(*key, "low", "high", "block", "node", "weight", "vector", "first", "before")
    dealt = full.repartition(*key, "low", "high").sortWithinPartitions(*key, "low", "high", "block", "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _groups(batches, 5):
            found = _tile_result(tile, cosine)
            if found is not None:
                yield found

    out = pin_table(dealt.mapInArrow(links, "node bigint, other bigint, links bigint"), "cap_links")
    return out.where("links is not null").groupBy("node").agg(F.sum("links").alias("links")), out.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst"))


def _groups(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `n_key` columns, from batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = np.stack([table.column(i).to_numpy() for i in range(n_key)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield table.slice(s, e - s)
        rest = table.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _tile_result(tile: pa.Table, cosine: float) -> pa.RecordBatch | None:
    tile = tile.combine_chunks()
    low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
    block = tile.column("block").to_numpy()
    if low != high and not (0 < (block == low).sum() < len(block)) or len(block) < 2:
        return None
    one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
    node, weight, unit = tile.column("node").to_numpy(), tile.column("weight").to_numpy(), _units(one(tile.column("vector")))
    lists = one(tile.column("before"))
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    first = tile.column("first").to_numpy()
    side = lambda m: {"node": node[m], "first": first[m], "unit": unit[m], "before": [flat[ends[k] : ends[k + 1]] for k in np.flatnonzero(m)], "at": np.flatnonzero(m)}
    a, b = side(block == low), side(block == high)
    i, j = _tile_links(a, b, cosine, low == high, tile.column("filter")[0].as_py())
    if not len(i):
        return None
    i, j = a["at"][i], b["at"][j]
    links = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
    root = np.arange(len(node))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    tree = [(k, r) for k in range(len(node)) if (r := find(k)) != k]
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([node[some], node[[k for k, _ in tree]]])), pa.array([None] * len(some) + [int(node[r]) for _, r in tree], pa.int64()), pa.array([int(x) for x in links[some]] + [None] * len(tree), pa.int64())],
        ["node", "other", "links"],
    )


def vector_groups(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 7) -> DataFrame:
    """For every row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept (vec_id is component_id).

    Vectors link when their labels are equal and not null, they have the same number of components
    and their cosine is at least `cosine`. Null vectors, zero vectors and those with null or
    non-finite components link with nothing. Equal vectors of a label link with each other. Rows that
    repeat an id count as rows: each is linked, and has the component of its own vector, which is the
    smallest id that the component's rows have. A null id is a row that has no id to give to its
    component. An empty table gives an empty result. Other columns play no part.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    can = F.col("label").isNotNull() & _usable(F.col("vector"))
    labels = pin(rows.where("label is not null").select("label").distinct().withColumn("label_id", F.monotonically_increasing_id()))
    equal = rows.where(can).groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    equal = pin_table(equal.join(labels, "label").withColumn("node", F.monotonically_increasing_id()), "cap_nodes")
    links, edges = cap_links(equal.select("node", F.col("label_id").alias("label"), "vector", "weight"), cosine, seed)
    roots = components(edges)
    joined = equal.select("node", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    joined = pin(joined.select("node", "least", "root", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = pin(joined.join(least, "root").select("node", "n_links", "component_id"))
    found = pin_table(equal.select("label", "vector", "node").join(known, "node").drop("node"), "cap_found")
    out = rows.where(can).join(found, ["label", "vector"]).unionByName(rows.where(~F.coalesce(can, F.lit(False))).withColumns({"n_links": F.lit(0), "component_id": F.col("vec_id")}))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
