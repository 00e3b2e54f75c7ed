from __future__ import annotations

import gzip

import pytest

from logweave.operators import sinks
from logweave.operators.parse import parse, split_quarantine
from logweave.sources.raw import first_physical_lines, numbered_lines
from logweave.sources.readers import adapter_for, discover, read_any_text, read_csv_stream, read_discovered, read_event_stream, read_event_text, read_event_xml, read_flow_csv, read_jsonl, read_text_log


@pytest.mark.parametrize("whole", [False, True])
def test_text_log_numbers_physical_lines(spark, tmp_path, rows, whole):
    (tmp_path / "a.log").write_bytes(b"one\r\n\n  \ntwo\nbad \xff end")
    found = read_text_log(spark, str(tmp_path / "a.log"), whole_files=whole)
    assert [(r.source_line, r.payload_text) for r in found.orderBy("source_line").collect()] == [(1, "one"), (4, "two"), (5, "bad � end")]
    assert found.select("raw_record_id").distinct().count() == 3


def test_numbers_are_dense_across_splits(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.log").write_text("".join(f"{f}{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        bad = lines.where("cast(substring(value, 2) as int) + 1 <> source_line").count()
        assert bad == 0 and lines.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_limits(spark, tmp_path):
    (tmp_path / "a.log").write_text("a\n\nb\nc\n")
    assert [r.payload_text for r in read_text_log(spark, str(tmp_path), 2).orderBy("source_line").collect()] == ["a", "b"]
    lines = numbered_lines(spark, str(tmp_path))
    assert [r.value for r in first_physical_lines(lines, 2).orderBy("source_line").collect()] == ["a", "b"]


def test_any_text_keeps_blank_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("x 2020-01-01 00:00:01 y\n\nz")
    found = read_any_text(spark, str(tmp_path), "d").orderBy("source_line").collect()
    assert [(r.payload_text, r.raw_timestamp) for r in found] == [("x 2020-01-01 00:00:01 y", "2020-01-01 00:00:01"), ("", None), ("z", None)]


def test_event_text_states_its_time(spark, tmp_path):
    (tmp_path / "a.log").write_text("timestamp=2020-01-01 rest\n")
    assert read_event_text(spark, str(tmp_path)).first().raw_timestamp == "2020-01-01 rest"


def test_flow_csv_prefers_its_times(spark, tmp_path):
    (tmp_path / "f.csv").write_text('StartTime,src,dst,timestamp,Timestamp\n1,a,"b,c",,9\n2,a,b,7,\n')
    found = read_flow_csv(spark, str(tmp_path / "f.csv")).orderBy("source_line").collect()
    assert [(r.source_line, r.raw_timestamp) for r in found] == [(2, "9"), (3, "7")]
    assert found[0].payload_map["dst"] == "b,c" and found[0].format == "json"
    assert [r.raw_timestamp for r in read_csv_stream(spark, str(tmp_path / "f.csv")).orderBy("source_line").collect()] == ["9", "2"]


def test_flow_csv_holds_line_breaks_in_quotes_and_headers_of_its_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,note,n\n1,"two\nlines, ""quoted""",5\n\n2,short\n', newline="")
    (tmp_path / "b.csv").write_text('n,StartTime,x,x\n7,9,first,second,beyond\n', newline="")
    found = {(r.source_file.rsplit("/", 1)[-1], r.source_line): r for r in read_flow_csv(spark, str(tmp_path)).collect()}
    assert set(found) == {("a.csv", 2), ("a.csv", 3), ("b.csv", 2)}
    assert found["a.csv", 2].payload_map == {"timestamp": "1", "note": 'two\nlines, "quoted"', "n": "5"} and found["a.csv", 2].raw_timestamp == "1"
    assert found["a.csv", 3].payload_map == {"timestamp": "2", "note": "short", "n": None}
    assert found["b.csv", 2].payload_map == {"n": "7", "StartTime": "9", "x": "second"} and found["b.csv", 2].raw_timestamp == "9"


def test_event_stream_by_file_name(spark, tmp_path):
    path = tmp_path / "auth.txt.gz"
    path.write_bytes(gzip.compress(b"1,u@d,v@d,c1,c2,k,n,on,ok\n,,\n2,u\n"))
    found = read_event_stream(spark, str(path)).orderBy("source_line").collect()
    assert [(r.source_line, r.raw_timestamp) for r in found] == [(1, "1"), (3, "2")]
    assert found[0].payload_map["status"] == "ok" and set(found[1].payload_map) == {"time", "source_user"}
    with pytest.raises(ValueError, match="unsupported"):
        read_event_stream(spark, str(tmp_path / "other.txt"))


def test_event_xml(spark, tmp_path):
    event = "<Event><System><EventID>{}</EventID><Computer>c</Computer><TimeCreated SystemTime='2020-01-01T00:00:00Z'/></System><EventData><Data Name='User'>bob</Data></EventData></Event>"
    (tmp_path / "e.xml").write_text("<Events>" + event.format(1) + event.format(2) + "</Events>")
    found = read_event_xml(spark, str(tmp_path / "e.xml")).orderBy("source_line").collect()
    assert [r.payload_map["EventID"] for r in found] == ["1", "2"]
    assert found[0].payload_map["User"] == "bob" and found[0].raw_timestamp == "2020-01-01T00:00:00Z"


def test_jsonl_is_strict_or_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path), "a int").collect()
    found = read_jsonl(spark, str(tmp_path), "a int", strict=False).collect()
    assert sorted((r.a or 0, r._corrupt_record is not None) for r in found) == [(0, True), (1, False)]


def test_discovery(spark, tmp_path):
    for name, text in {"sandworm/x_labelled.csv": "timestamp,a\n1,2\n", "ctu13/scenario_5/f.csv": "StartTime,a\n1,2\n", "ctu13/scenario_5/f.part": "x", "ctu13/scenario_1/f.csv": "x", "splunk_attack_data/d/a.log": "one\n", "splunk_attack_data/a.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.dataset_id for r in discover(spark, str(tmp_path)).collect()) == ["ctu13_selected", "sandworm_flow", "splunk_attack_data"]
    assert read_discovered(spark, str(tmp_path)).count() == 3


def test_adapter_for():
    assert adapter_for("loghub_2_0") is read_text_log and adapter_for("evtx_attack_samples") is read_event_xml
    with pytest.raises(ValueError, match="no reader"):
        adapter_for("other")


def test_parse_and_split_output(spark, tmp_path):
    (tmp_path / "a.log").write_text("2026-01-01T00:00:00Z hello\nno time\n")
    from logweave.sources.readers import read_timed_text

    p = parse(read_timed_text(spark, str(tmp_path / "a.log"), "d"))
    valid, bad = split_quarantine(p)
    assert [r.template_text for r in valid.collect()] == ["hello"]
    assert [(r.quarantine_reason, r.parse_confidence) for r in bad.collect()] == [("missing_timestamp", 0.0)]
    counts = sinks.write_split(p, str(tmp_path / "out"))
    assert counts == {"rows": 2, "valid": 1, "quarantined": 1}
    assert spark.read.parquet(str(tmp_path / "out")).where("quarantined = 'true'").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z int, a string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    lines = sorted(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines())
    assert lines == ['{"a":"b","z":2}', '{"a":null,"z":1}']
    m = sinks.run_stage(df, "half", lambda d: d.where("z > 1"), str(tmp_path / "o")).first()
    assert (m.input_count, m.output_count, m.rejected_count) == (2, 1, 1) and list(m.outputs) == [str(tmp_path / "o")]
    sinks.append_operation(spark, str(tmp_path / "log"), "a", "ok")
    sinks.append_operation(spark, str(tmp_path / "log"), "b", "ok", {"x": "1"})
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert sinks.content_digest(df) == sinks.content_digest(df.orderBy("z")) != sinks.content_digest(df.where("z = 1"))
