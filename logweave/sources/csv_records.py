"""Records of CSV files whose values may hold line breaks in quotes, read by splits.

Whether a line begins inside quotes hangs on all before it, but as one of two cases. A first scan
says for each split how it would end, and how many records, if it began outside quotes and if it
began inside. Along each file these answers, one row a split, settle where every split stands. The
second scan then cuts each split into records. What a split begins or ends in the middle of is
handed on as text, and put together with its other parts.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.pinning import pin_table

#: A line that begins outside quotes and ends inside: whole fields, then a quote without its end.
_ENDS_INSIDE = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+\Z')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line with its line break ends inside quotes, if it began so or not."""
    if '"' not in line:
        return inside
    return _ENDS_INSIDE.match('"' + line if inside else line) is not None


def _lines(raw: bytes) -> list[str]:
    """What ended at a line feed as lines with their breaks: a lone carriage return ends one too."""
    text = raw.decode("utf-8", "replace") + "\n"
    return list(io.StringIO(text, newline="")) if "\r" in text else [text]


def _blank(line: str) -> bool:
    return line in ("\n", "\r\n", "\r")


def cells_of(record: str) -> list[str]:
    """The values of one record."""
    if '"' not in record:
        return record.rstrip("\r\n").split(",")
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader(io.StringIO(record, newline="")), [])


class _Case:
    """One of the two cases of a split: where it stands and how many records have ended."""

    def __init__(self, inside: bool, blanks: bool):
        self.inside, self.ended, self.blanks = inside, 0, blanks

    def step(self, line: str) -> None:
        before, self.inside = self.inside, ends_inside(line, self.inside)
        if not self.inside and (before or self.blanks or not _blank(line)):
            self.ended += 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where another split of a file begins: (file, block) with its rows."""
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], b.slice(start, i - start)
                start = i


def _scan(blanks: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cases = None, ()
        row = lambda: pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "inside0": cases[0].inside, "n0": cases[0].ended, "inside1": cases[1].inside, "n1": cases[1].ended}])
        for key, rows in _splits(batches):
            if key != now:
                if now:
                    yield row()
                now, cases = key, (_Case(False, blanks), _Case(True, blanks))
            for raw in rows.column(2).to_pylist():
                for line in _lines(raw):
                    cases[0].step(line)
                    cases[1].step(line)
        if now:
            yield row()

    return scan


def _settled(splits: pd.DataFrame) -> pd.DataFrame:
    """Where each split of a file stands at its start, and how many records ended before."""
    splits, inside, before, out = splits.sort_values("block"), False, 0, []
    for s in splits.itertuples():
        out.append((s.file, s.block, inside, before))
        before += s.n1 if inside else s.n0
        inside = s.inside1 if inside else s.inside0
    return pd.DataFrame(out, columns=["file", "block", "inside", "before"])


def _cut(blanks: bool):
    """Rows (file, number, block, cells, part): a whole record's cells, or the text of a part of one."""
    schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("cells", pa.list_(pa.string())), ("part", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, inside, head, held = None, 0, False, False, []
        for key, rows in _splits(batches):
            out = []
            if key != now:
                if held:
                    out.append((now[0], number, now[1], None, "".join(held)))
                now, held = key, []
                number, inside = rows.column(4)[0].as_py() + 1, rows.column(3)[0].as_py()
                head = inside
            for raw in rows.column(2).to_pylist():
                for line in _lines(raw):
                    before, inside = inside, ends_inside(line, inside)
                    if not before and not inside:
                        if blanks or not _blank(line):
                            out.append((key[0], number, key[1], [] if _blank(line) else cells_of(line), None))
                            number += 1
                        continue
                    held.append(line)
                    if not inside:
                        text = "".join(held)
                        out.append((key[0], number, key[1], None, text) if head else (key[0], number, key[1], cells_of(text), None))
                        number, held, head = number + 1, [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now[0], number, now[1], None, "".join(held)), schema, strict=True)], schema=schema)

    return cut


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([cells_of(t) for t in b.column(2).to_pylist()], pa.list_(pa.string()))], ["file", "number", "cells"])


def csv_records(spark: SparkSession, path: str | list[str], blank_lines: bool = False) -> DataFrame:
    """(source_file, source_line, cells): the records of CSV files, numbered from 1 in each file, pinned.

    Files are split as Spark likes, compressed ones aside. Line breaks are LF, CR or both; in quotes
    they're a value's, as they are. A quote opens a value only at its start, and stands for itself
    elsewhere. Empty values are empty strings. Blank lines are no records, unless `blank_lines` asks for
    records without cells. A last record whose quotes aren't closed ends with the file. An empty file has none.
    """
    read = spark.read.text(path, lineSep="\n")
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    scanned = lines.mapInArrow(_scan(blank_lines), "file string, block bigint, inside0 boolean, n0 bigint, inside1 boolean, n1 bigint")
    starts = pin_table(scanned.groupBy("file").applyInPandas(_settled, "file string, block bigint, inside boolean, before bigint"), "csv_splits")
    # a row for each split, which must not shuffle the lines: their order counts
    placed = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "inside", "before")
    found = pin_table(placed.mapInArrow(_cut(blank_lines), "file string, number bigint, block bigint, cells array<string>, part string"), "csv_records")
    parts = found.where("part is not null").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "").alias("text"))
    whole = found.where("part is null").select("file", "number", "cells").unionByName(parts.mapInArrow(_joined, "file string, number bigint, cells array<string>"))
    return whole.select(F.col("file").alias("source_file"), F.col("number").alias("source_line"), "cells")
