"""The format `log_lines`: physical lines of text files, as a table or as a stream that follows files as they grow.

A range of bytes owns the lines that end in it, so any cut of a file into ranges gives each line
once, whatever is appended later. LF, CR or both end a line. A CR is known to stand alone by the byte
after it, so such a line ends there. The unfinished line at a file's end belongs to the table, while
the stream waits for its end. Lines are numbered afterwards, from their counts by range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "log_lines"
SPLIT_BYTES = 64 << 20
READ_BYTES = 1 << 20
_BREAK = re.compile(rb"\r\n|\n|\r(?=[^\n])")
_ARROW = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("value", pa.string())])


@dataclass
class ByteRange(InputPartition):
    """Bytes of a file from `start` to before `end`; `last` if the file ends there for good."""

    source_file: str
    path: str
    start: int
    end: int
    last: bool


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path on it, address of that path) of a plain path or an address."""
    if path.startswith("file:") or "://" not in path:
        local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        local = local.rstrip("/") or "/"
        return fs.LocalFileSystem(), local, "file:" + quote(local)
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), path.rstrip("/")


def listed(path: str) -> dict[str, tuple[str, int]]:
    """address -> (path, bytes) of a file, or of the files under a folder; names that begin with _ or . are left out, as Spark does."""
    system, inner, address = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.type == fs.FileType.File]
    out = {}
    for i in found:
        below = i.path[len(inner) :]
        if any(part[:1] in ("_", ".") for part in below.split("/") if part):
            continue
        if i.extension in ("gz", "bz2", "zst", "xz"):
            raise ValueError(f"{NAME} reads plain text, not {i.path}")
        out[address + quote(below)] = (i.path, i.size)
    return out


def _ranges(source_file: str, path: str, start: int, end: int, step: int, last: bool) -> list[ByteRange]:
    return [ByteRange(source_file, path, at, min(at + step, end), last and at + step >= end) for at in range(start, end, step)]


def _unfinished(file: pa.NativeFile, start: int) -> bytes:
    """What lies before `start` of the line that goes on there."""
    parts, at, after = [], start, b""
    while at > 0:
        low = max(0, at - (64 << 10))
        file.seek(low)
        block = file.read(at - low)
        ends = [m.end() for m in _BREAK.finditer(block + after)]
        parts.insert(0, block[ends[-1] :] if ends else block)
        if ends:
            break
        at, after = low, block[:1]
    return b"".join(parts)


def lines_in(file: pa.NativeFile, start: int, end: int, last: bool) -> Iterator[bytes]:
    """The lines that end in a range, without their ends. The line's part before the range is looked up only once an end is found."""
    at, first, parts = start, True, [b""]
    if start:
        file.seek(start - 1)
        parts = [b"\r"] if file.read(1) == b"\r" else [b""]
    while at < end:
        file.seek(at)
        chunk = file.read(min(READ_BYTES, end - at))
        if not chunk:
            raise EOFError(f"a file lost bytes at {at}")
        at += len(chunk)
        if parts[-1].endswith(b"\r"):  # alone or not: this chunk tells
            parts[-1], chunk = parts[-1][:-1], b"\r" + chunk
        pieces = _BREAK.split(chunk)
        parts.append(pieces[0])
        if len(pieces) > 1:
            yield (_before(file, start) if first else b"") + b"".join(parts)
            yield from pieces[1:-1]
            first, parts = False, [pieces[-1]]
    rest = b"".join(parts)
    if last:
        whole = (_before(file, start) if first else b"") + rest
        if whole:
            yield whole.removesuffix(b"\r")


def _before(file: pa.NativeFile, start: int) -> bytes:
    """As _unfinished, without a CR at its very end, which lines_in has kept."""
    return _unfinished(file, start).removesuffix(b"\r") if start else b""


def _batches(part: ByteRange, size: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """A range's lines in batches of about `size` bytes. Bad UTF-8 is replaced."""
    system = _opened(part.source_file)[0]
    with system.open_input_file(part.path) as file:
        held, weight, done = [], 0, 0
        for line in lines_in(file, part.start, part.end, part.last):
            held.append(line.decode("utf-8", "replace"))
            weight += len(line) + 8
            if weight >= size:
                yield _batch(part, held, done)
                done, held, weight = done + len(held), [], 0
        if held:
            yield _batch(part, held, done)


def _batch(part: ByteRange, lines: list[str], done: int) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([part.source_file] * n, pa.string()), pa.array([part.start] * n, pa.int64()), pa.array(range(done, done + n), pa.int64()), pa.array(lines, pa.string())], schema=_ARROW)


class _Table(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[ByteRange]:
        found = [r for address, (path, size) in sorted(listed(self.path).items()) for r in _ranges(address, path, 0, size, self.step, True)]
        return found or [ByteRange("", "", 0, 0, False)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _Tail(DataSourceStreamReader):
    """Offsets are bytes by file, so what a batch holds is settled by its offsets and a repeated batch has the same lines."""

    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {address: size for address, (_, size) in sorted(listed(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        paths, out = listed(self.path), []
        for address, size in end.items():
            if size < start.get(address, 0):
                raise ValueError(f"{address} has fewer bytes than were read of it")
            if size > start.get(address, 0):
                out += _ranges(address, paths[address][0], start.get(address, 0), size, self.step, False)
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class LogLines(DataSource):
    """Rows (source_file, block, at, value): a line, the first byte of the range it was read in, and its place among that range's lines.

    Options: path, a file or a folder, on any storage that Arrow's file systems open; split_bytes. A
    stream takes all that has been appended as one batch, cut into ranges; it fails where a file
    has shrunk, and reads a file that was gone and is back as a new one. Its offset names
    every file under the path, so old files should be moved away.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source_file string, block bigint, at bigint, value string"

    def _settings(self) -> tuple[str, int]:
        if "path" not in self.options:
            raise ValueError(f"{NAME} needs a path")
        step = int(self.options.get("split_bytes", SPLIT_BYTES))
        if step < 1:
            raise ValueError("split_bytes must be positive")
        return self.options["path"], step

    def reader(self, schema) -> DataSourceReader:
        return _Table(*self._settings())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(*self._settings())


def register(spark: SparkSession) -> None:
    """Makes the format known to the session: spark.read.format("log_lines"), readStream, and in SQL temporary views USING log_lines (tables of a catalog pass no options on)."""
    spark.dataSource.register(LogLines)


def counted_ranges(lines: DataFrame) -> DataFrame:
    """(source_file, block, n) of rows of the format: a row for each range with a line."""
    return lines.groupBy("source_file", "block").agg(F.count("*").alias("n"))


def numbered_ranges(lines: DataFrame, ranges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(source_file, source_line, value): lines of the format numbered from 1 in their file, or on from `before` (source_file, lines)."""
    starts = ranges.withColumn("__before", F.sum("n").over(W.partitionBy("source_file").orderBy("block")) - F.col("n"))
    if before is not None:
        known = before.select("source_file", F.col("lines").alias("__lines"))
        starts = starts.join(known, "source_file", "left").withColumn("__before", F.col("__before") + F.coalesce("__lines", F.lit(0)))
    numbered = lines.join(starts.select("source_file", "block", "__before"), ["source_file", "block"])
    return numbered.select("source_file", (F.col("at") + F.col("__before") + 1).cast("long").alias("source_line"), "value")
