"""Packing token sequences into as few fixed-length sequences as it can.

Only lengths matter for that, and there are no more different lengths than a sequence has tokens.
So the instance, whatever the corpus, is a histogram, which Spark counts and the driver reduces and
packs in bulk:

1. Martello-Toth dominance: a set that holds a document and leaves nothing that any other set with
   that document could do better is fixed for good: two that fill a sequence exactly, one that no
   other fits beside, one with its largest partner where at most one fits beside, or at most two
   and no two of them weigh more than that partner. The instance shrinks, until no rule applies.
2. Best fit, longest first, packs the remainder.

The result is a bounded table of slots: which ranks of a length go to which place. Ranks of a
length are dealt out on the executors by buckets, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm.arrow import small
from logweave.llm.token_counts import batched_ids, ranks_of, vocabulary_path
from logweave.operators.pinning import pin, pin_table

CAPACITY = 2048

#: So many sequences alike: (how many, ((length, times), ...)).
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def _best_pair(lengths: list[int], counts: list[int], room: int) -> int:
    """The most tokens of two documents that fit into `room` together; 0 if no two do. `lengths` ascend."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
        elif i == j and counts[lengths[i]] < 2:
            break
        else:
            best, i = max(best, total), i + 1
    return best


def reduce_by_dominance(counts: list[int], capacity: int) -> list[Pattern]:
    """Takes what dominance fixes out of counts[length], and returns it."""
    fixed: list[Pattern] = []

    def fix(n: int, *lengths: int) -> None:
        for x in lengths:
            counts[x] -= n
        fixed.append((n, tuple((x, len([*same])) for x, same in groupby(lengths))))

    for a in range(capacity, capacity // 2 - 1, -1):
        b = capacity - a
        if n := counts[a] if b == 0 else counts[a] // 2 if a == b else min(counts[a], counts[b]):
            fix(n, *([a, b] if b else [a]))
    before = -1
    while before != len(fixed):
        before = len(fixed)
        for a in range(capacity, 0, -1):
            while counts[a]:
                lengths = [x for x in range(1, capacity + 1) if counts[x] - (x == a)]
                least = [x for x in lengths[:3] for _ in range(min(3, counts[x] - (x == a)))][:3]
                partner = lengths[bisect_right(lengths, capacity - a) - 1] if lengths and lengths[0] <= capacity - a else 0
                if not partner:
                    fix(counts[a], a)
                elif len(least) < 2 or a + least[0] + least[1] > capacity:  # at most one fits beside it
                    fix(counts[a] // 2 if partner == a else min(counts[a], counts[partner]), a, partner)
                elif len(least) < 3 or a + sum(least) > capacity:  # at most two
                    counts[a] -= 1
                    pair = _best_pair(lengths, counts, capacity - a)
                    counts[a] += 1
                    if pair > partner:
                        break
                    fix(counts[a] // 2 if partner == a else min(counts[a], counts[partner]), a, partner)  # fewer documents offer no better pair
                else:
                    break
            if lengths_fit_three(counts, a, capacity):
                break
    return fixed


def lengths_fit_three(counts: list[int], a: int, capacity: int) -> bool:
    """Whether three documents fit beside one of length `a`: then no rule applies to it, nor to shorter ones."""
    total, left = a, 3
    for x in range(1, capacity + 1):
        n = min(left, counts[x] - (x == a and counts[x] > 0))
        total, left = total + n * x, left - n
        if total > capacity:
            return False
        if not left:
            return True
    return False


def best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, for counts[length] documents of each length: alike sequences are filled together."""
    by_room: dict[int, list[list]] = {}  # room left -> [how many, content]

    def put(n: int, content: tuple, length: int, times: int, room: int) -> None:
        if n:
            by_room.setdefault(room - length * times, []).append([n, (*content, (length, times)) if times else content])

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            each = (capacity if room is None else room) // length
            if room is None:
                full, rest = divmod(left, each)
                put(full, (), length, each, capacity)
                put(int(rest > 0), (), length, rest, capacity)
                left = 0
                continue
            n, content = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            full, rest = min(n, left // each), left % each if left // each < n else 0
            put(full, content, length, each, room)
            put(int(rest > 0), content, length, rest, room)
            if n > full + (rest > 0):
                by_room.setdefault(room, []).append([n - full - (rest > 0), content])
            left -= full * each + rest
    return [(n, content) for groups in by_room.values() for n, content in groups]


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    fixed = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slot_table(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, offset), by length and rank."""
    rows, ranks, sequence = [], Counter(), 0
    for n, content in patterns:
        offset = 0
        for length, times in content:
            rows.append((length, ranks[length], sequence, times, offset))
            ranks[length] += n * times
            offset += length * times
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, tie: list[str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to every row of `items` (pinned), whose `length` is 1 to `capacity`.

    Rows of equal length can change places; `tie`, all columns by default, says by what they're
    ordered among themselves. Repeated rows each get a place. An empty table stays empty.
    """
    sizes = pin_table(items.groupBy(length).agg(F.count("*").alias("__of")), "piece_lengths")
    histogram = {r[0]: r[1] for r in sizes.collect()}  # at most `capacity` rows
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = items.sparkSession.sparkContext.broadcast(slot_table(plan_patterns(histogram, capacity)))  # bounded by the capacity, as patterns are
    tie = tie or items.columns
    # a length's rows are ranked by buckets, as many as the root of the rows over eight: neither buckets nor their rows grow with the rows themselves
    dealt = items.join(sizes, length).withColumn("__bucket", F.pmod(F.xxhash64(*tie), F.ceil(F.sqrt("__of") / 8)))
    per = dealt.groupBy(length, "__bucket").agg(F.count("*").alias("__n"))
    first = pin(per.select(length, "__bucket", (F.sum("__n").over(W.partitionBy(length).orderBy("__bucket")) - F.col("__n")).alias("__first")))
    ranked = dealt.join(first, [length, "__bucket"]).withColumn("__rank", F.row_number().over(W.partitionBy(length, "__bucket").orderBy(*tie)) - 1 + F.col("__first"))
    base = ranked.select(F.col(length).cast("long").alias("__length"), F.col("__rank").cast("long").alias("__rank"), *items.columns)

    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        starts = (table[:, 0] << 42) + table[:, 1]
        for b in batches:
            lengths, ranks = (b.column(i).to_numpy() for i in (0, 1))
            slot = table[np.searchsorted(starts, (lengths << 42) + ranks, side="right") - 1]
            nth = ranks - slot[:, 1]
            where = [pa.array(slot[:, 2] + nth // slot[:, 3]), pa.array(slot[:, 4] + nth % slot[:, 3] * lengths)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *where], [*names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields]
    return base.mapInArrow(place, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = 0, id_col: str | Column = "doc_id", text: str | Column = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): each document's ids and an end id, cut to pieces.

    A null text is an empty one: its piece is the end id alone. A document of over `capacity` ids is
    cut so that only its first piece is shorter. The crc is of the ids as little-endian 32 bits.
    """
    path = vocabulary_path(vocabulary)
    ranks = ranks_of(path)
    base = docs.select((text if isinstance(text, Column) else F.col(text)).cast("string").alias("text"), (id_col if isinstance(id_col, Column) else F.col(id_col)).cast("long").alias("doc_id"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(ids: np.ndarray) -> Iterator[tuple]:
        first = len(ids) % capacity or capacity
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start : start + (capacity if k else first)].astype("<u4")
            yield k, start, len(part), zlib.crc32(part.tobytes()), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for b in small(batches):
            own, rows = b.column(1).to_pylist(), []
            for i, group in groupby(batched_ids(b.column(0).to_pylist(), path, ranks), key=lambda x: x[0]):
                rows += [(own[i], *p) for p in pieces(np.concatenate([*(ids for _, ids in group), end]))]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return base.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, id_col: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row for each piece of each row of `docs`, with sequence_id and offset: every sequence is filled from 0 without gaps.

    Rows with null or repeated ids, or repeated as a whole, are packed like any others. An empty
    table gives an empty result.
    """
    return pack(pin(token_pieces(docs, vocabulary, capacity, id_col=id_col, text=text)), "length", capacity)
