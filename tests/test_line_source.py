"""The line format: any cut of any bytes gives each line once, and a tailed log has the records of a batch read."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logweave.sources import line_source
from logweave.sources.raw import RAW, numbered_lines
from logweave.sources.readers import read_text_log
from logweave.streaming import tail


def by_definition(data: bytes) -> list[bytes]:
    lines = re.split(rb"\r\n|\r|\n", data)
    return lines[:-1] if lines[-1] == b"" else lines


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"\r", b"\n", b"\r\n", b"a", b"bc", b"\xff"]), max_size=30), st.lists(st.integers(0, 40), max_size=5), st.integers(1, 4))
def test_any_cut_gives_each_line_once(pieces, cuts, read):
    data = b"".join(pieces)
    edges = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    old, line_source.READ_BYTES = line_source.READ_BYTES, read
    try:
        file = pa.BufferReader(data)
        got = [x for s, e in zip(edges, edges[1:], strict=False) for x in line_source.lines_in(file, s, e, e == len(data))]
        assert got == by_definition(data)
        # a stream leaves what isn't finished, and a lone CR at the end isn't known to stand alone
        open_ended = [x for s, e in zip(edges, edges[1:], strict=False) for x in line_source.lines_in(file, s, e, False)]
        done = data[: -1] if data.endswith(b"\r") else data
        assert open_ended == re.split(rb"\r\n|\r|\n", done)[:-1]
    finally:
        line_source.READ_BYTES = old


def test_a_line_longer_than_ranges_and_blocks():
    data = b"a\n" + b"x" * 200_000 + b"\r\nlast"
    file = pa.BufferReader(data)
    got = [x for s in range(0, len(data), 1000) for x in line_source.lines_in(file, s, min(s + 1000, len(data)), s + 1000 >= len(data))]
    assert got == [b"a", b"x" * 200_000, b"last"]


def test_table_equals_the_text_reader(spark, tmp_path, rows):
    (tmp_path / "in" / "deep er").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_bytes(b"one\r\n\ntwo\rthree\n\nlast")
    (tmp_path / "in" / "deep er" / "b.log").write_text("".join(f"line {i} é\n" for i in range(500)))
    (tmp_path / "in" / "empty.log").write_text("")
    (tmp_path / "in" / "_SUCCESS").write_text("not read\n")
    line_source.register(spark)
    lines = spark.read.format("log_lines").option("split_bytes", 211).load(str(tmp_path / "in"))
    got = line_source.numbered_ranges(lines, line_source.counted_ranges(lines))
    want = numbered_lines(spark, [str(tmp_path / "in"), str(tmp_path / "in" / "deep er")])
    assert rows(got, "source_file", "source_line", "value") == rows(want, "source_file", "source_line", "value")
    assert got.count() == 506


def test_the_format_in_sql(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    line_source.register(spark)
    spark.sql(f"CREATE TEMPORARY VIEW some_log USING log_lines OPTIONS (path '{tmp_path / 'a.log'}')")
    try:
        assert [r.value for r in spark.sql("SELECT value FROM some_log WHERE at = 1").collect()] == ["two"]
    finally:
        spark.sql("DROP VIEW some_log")


def test_table_of_nothing_and_what_it_refuses(spark, tmp_path):
    line_source.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("log_lines").load(str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "a.log.gz").write_bytes(b"x")
    with pytest.raises(Exception, match="plain text"):
        spark.read.format("log_lines").load(str(tmp_path / "none")).count()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("log_lines").load().count()


def run(spark, tmp_path):
    q = tail.tail_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), split_bytes=16).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_tailed_log_has_the_records_of_a_batch_read(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    a.write_bytes(b"one\n\ntwo\nunfini")
    run(spark, tmp_path)
    assert rows(tail.tailed_records(spark, str(tmp_path / "out")), "source_line", "payload_text") == [(1, "one"), (3, "two")]
    with a.open("ab") as f:
        f.write(b"shed\r")
    b.write_text("".join(f"b{i} and more\n" for i in range(40)))
    run(spark, tmp_path)
    with a.open("ab") as f:
        f.write(b"\n" + "".join(f"a{i} and more\n" for i in range(40)).encode())
    with b.open("ab") as f:
        f.write(b"end\n")
    run(spark, tmp_path)
    got = tail.tailed_records(spark, str(tmp_path / "out"))
    assert rows(got, *RAW) == rows(read_text_log(spark, str(tmp_path / "in")), *RAW)
    assert got.count() == 84 and got.where("source_line = 4").where(F.col("source_file").endswith("a.log")).first().payload_text == "unfinished"


def test_a_batch_cut_off_before_its_commit_is_the_same_again(spark, tmp_path, rows, monkeypatch):
    (tmp_path / "in").mkdir()
    a = tmp_path / "in" / "a.log"
    a.write_text("one\ntwo\n")
    run(spark, tmp_path)
    a.write_text("one\ntwo\nthree\n")
    whole = tail.write_batch

    def cut(outputs, root, number):
        whole({tail.RECORDS: outputs[tail.RECORDS]}, f"{root}-lost", number)
        outputs[tail.RECORDS].write.mode("overwrite").parquet(f"{root}/{tail.RECORDS}/batch={number}")
        raise RuntimeError("cut off")

    monkeypatch.setattr(tail, "write_batch", cut)
    with pytest.raises(StreamingQueryException, match="cut off"):
        run(spark, tmp_path)
    assert tail.tailed_records(spark, str(tmp_path / "out")).count() == 2
    monkeypatch.setattr(tail, "write_batch", whole)
    a.write_text("one\ntwo\nthree\nfour\n")
    run(spark, tmp_path)  # the planned batch, with the bytes it had
    assert tail.tailed_records(spark, str(tmp_path / "out")).count() == 3
    run(spark, tmp_path)
    assert rows(tail.tailed_records(spark, str(tmp_path / "out")), *RAW) == rows(read_text_log(spark, str(tmp_path / "in")), *RAW)


def test_a_file_that_shrank_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    run(spark, tmp_path)
    (tmp_path / "in" / "a.log").write_text("new\n")
    with pytest.raises(StreamingQueryException, match="fewer bytes"):
        run(spark, tmp_path)
