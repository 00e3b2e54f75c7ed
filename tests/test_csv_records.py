from __future__ import annotations

import csv
import random

import pytest

from logweave.sources.csv_records import csv_records, ends_inside
from logweave.sources.raw import numbered_lines
from logweave.sources.readers import adapter_for, read_event_stream, read_flow_csv


def _expected(path, blanks=False):
    with open(path, newline="", encoding="utf-8", errors="replace") as f:
        rows = list(csv.reader(f))
    return [(i, r) for i, r in enumerate([r for r in rows if r or blanks], 1)]


def _found(spark, path, **more):
    return sorted((r.source_line, list(r.cells)) for r in csv_records(spark, str(path), **more).collect())


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def _random_file(rng) -> str:
    cell = lambda: "".join(rng.choice(["a", "b", '""', ",", "\n", "\r\n", "\r", "é", " "]) for _ in range(rng.choice([0, 1, 3, 9, 60])))
    plain = lambda: "".join(rng.choice(['x', 'y"', " ", "'"]) for _ in range(rng.randint(0, 5))).lstrip('"')
    record = lambda: ",".join(f'"{cell()}"' + rng.choice(["", "", "z", ' "']) if rng.random() < 0.6 else plain() for _ in range(rng.randint(1, 4)))
    return "".join(record() + rng.choice(["\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(60))


def test_records_equal_a_reader_of_whole_files_however_files_are_split(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    for n in range(4):
        path = tmp_path / f"{n}.csv"
        path.write_text(_random_file(rng), newline="", encoding="utf-8")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        assert _found(spark, path) == _expected(path)
        assert _found(spark, path, blank_lines=True) == _expected(path, True)


def test_a_record_over_many_splits_and_one_that_never_ends(spark, tmp_path, tiny_splits):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"' + "line of a value\n" * 200 + '"\n2,"open' + "\nmore" * 3 + "\n", newline="")
    assert _found(spark, path) == _expected(path)


def test_several_files_and_an_empty_one(spark, tmp_path):
    for name, text in (("a", 'x,y\n1,"2\n3"\n'), ("b", "p\n"), ("c", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = {(r.source_file.rsplit("/", 1)[-1], r.source_line): list(r.cells) for r in csv_records(spark, str(tmp_path)).collect()}
    assert found == {("a.csv", 1): ["x", "y"], ("a.csv", 2): ["1", "2\n3"], ("b.csv", 1): ["p"]}


@pytest.mark.parametrize(("line", "outside", "inside"), [("a,b\n", False, True), ('a,"b\n', True, False), ('"a""\n', True, False), ('","\n', False, True), ('a"b\n', False, False), ('"a"b"\n', False, False), ('x,"",""\n', False, True)])
def test_ends_inside(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


def test_values_keep_their_places_behind_an_unnamed_column(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('timestamp,,c\n1,2,3\n4,,\n5\n')
    rows = [(r.raw_timestamp, r.payload_map) for r in read_flow_csv(spark, str(path)).orderBy("source_line").collect()]
    assert rows == [("1", {"timestamp": "1", "": "2", "c": "3"}), ("4", {"timestamp": "4", "": "", "c": ""}), ("5", {"timestamp": "5", "": None, "c": None})]


def test_a_header_over_two_lines_keeps_its_columns(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('"a\nx",b,timestamp\n1,2,3\n')
    r = read_flow_csv(spark, str(path)).first()
    assert (r.raw_timestamp, r.payload_map, r.source_line) == ("3", {"a\nx": "1", "b": "2", "timestamp": "3"}, 2)


def test_event_streams_hold_line_breaks_and_count_blank_lines(spark, tmp_path):
    path = tmp_path / "dns.txt"
    path.write_text('1,"a\nb",c\n\n,,\n2,x\n', newline="")
    found = [(r.source_line, r.raw_timestamp, r.payload_map) for r in read_event_stream(spark, str(path)).orderBy("source_line").collect()]
    assert found == [(1, "1", {"time": "1", "source_computer": "a\nb", "resolved_computer": "c"}), (4, "2", {"time": "2", "source_computer": "x"})]


@pytest.mark.parametrize("whole", [False, True])
def test_a_lone_carriage_return_ends_a_line_in_both_ways_of_reading(spark, tmp_path, whole):
    (tmp_path / "a.log").write_bytes(b"one\rtwo\nthree\r\n\r\nfive")
    found = numbered_lines(spark, str(tmp_path), whole).orderBy("source_line").collect()
    assert [(r.source_line, r.value) for r in found] == [(1, "one"), (2, "two"), (3, "three"), (4, ""), (5, "five")]


def test_adapters_by_dataset(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp\n7\n")
    assert adapter_for("sandworm_flow")(spark, str(tmp_path)).first().raw_timestamp == "7"
    with pytest.raises(ValueError, match="no reader"):
        adapter_for("other")
