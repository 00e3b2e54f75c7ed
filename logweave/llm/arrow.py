"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most `limit` bytes, or of one item that alone has more."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def small(batches: Iterator[pa.RecordBatch], text: int = 0, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of column `text`, so that what a function makes of one stays small."""
    for batch in batches:
        sizes = batch.column(text).cast(pa.binary() if batch.column(text).type == pa.string() else pa.large_binary())
        for a, b in slices_by_bytes(pc.fill_null(pc.binary_length(sizes), 0).to_pylist(), limit):
            yield batch.slice(a, b - a)
