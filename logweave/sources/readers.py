"""Sources by format, and the table of which dataset is read how."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import is_blank, leading_timestamp, non_empty, timestamp_anywhere, timestamp_of_event
from logweave.sources.csv_records import csv_records
from logweave.sources.raw import limited, numbered_lines, numbered_rows, raw_records
from logweave.vocabulary import STREAM_COLUMNS

#: Which time column of a flow table counts, best first.
FLOW_TIMES = ("timestamp", "Timestamp", "StartTime")
STREAM_TIMES = ("Timestamp", "StartTime", "timestamp")


Path = str | list[str]


def read_text_log(spark: SparkSession, path: Path, limit: int = 0, dataset_id: str = "loghub_2_0", whole_files: bool = False) -> DataFrame:
    """Non-blank lines of text logs; blank ones count in the numbering."""
    lines = numbered_lines(spark, path, whole_files).where(~is_blank(F.col("value")))
    return raw_records(limited(lines, limit), dataset_id, "loghub_text_v1", text=F.col("value"))


def read_event_text(spark: SparkSession, path: Path, limit: int = 0, dataset_id: str = "splunk_attack_data", whole_files: bool = False) -> DataFrame:
    """As read_text_log, with the time that the line's event states."""
    lines = numbered_lines(spark, path, whole_files).where(~is_blank(F.col("value")))
    return raw_records(limited(lines, limit), dataset_id, "text_stream_v1", text=F.col("value"), timestamp=timestamp_of_event(F.col("value")))


def read_any_text(spark: SparkSession, path: str, dataset_id: str, whole_files: bool = False) -> DataFrame:
    """All lines, blank ones too, with the first date and time found in each."""
    lines = numbered_lines(spark, path, whole_files)
    return raw_records(lines, dataset_id, "preprocess_v1", text=F.col("value"), timestamp=timestamp_anywhere(F.col("value")))


def read_timed_text(spark: SparkSession, path: str, dataset_id: str, whole_files: bool = False) -> DataFrame:
    """Non-blank lines that may begin with a time: it is split off."""
    lines = numbered_lines(spark, path, whole_files).where(~is_blank(F.col("value")))
    time, rest = leading_timestamp(F.col("value"))
    return raw_records(lines, dataset_id, "timed_text_v1", text=rest, timestamp=time)


def read_flow_csv(spark: SparkSession, path: Path, limit: int = 0, dataset_id: str = "sandworm_flow", times: tuple[str, ...] = FLOW_TIMES, version: str = "csv_stream_v1") -> DataFrame:
    """CSV files, each with a header of its own, all values strings. The time is the first of `times` that isn't empty.

    Records are numbered, the header being 1; blank lines aren't records. Values may hold line breaks
    in quotes, see csv_records. A name in the header may be empty or hold a line break. A record shorter
    than its header has nulls, one that is longer loses what has no name, and of equal names the last
    counts. A byte order mark before the header is dropped.
    """
    rows = csv_records(spark, path)
    names = F.transform("cells", lambda n, i: F.when(i == 0, F.ltrim(n, F.lit("\ufeff"))).otherwise(n))
    header = rows.where("source_line = 1").select("source_file", names.alias("names"))
    rows = rows.where("source_line > 1").join(header, "source_file")
    last = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.array_contains(F.slice("names", i + 2, F.size("names")), F.get("names", i)))
    rows = rows.withColumn("row", F.map_from_entries(F.transform(last, lambda i: F.struct(F.get("names", i), F.get("cells", i)))))
    time = F.coalesce(*[non_empty(F.col("row")[n]) for n in times])
    return raw_records(limited(rows, limit), dataset_id, version, fields=F.col("row"), timestamp=time)


def read_csv_stream(spark: SparkSession, path: Path, dataset_id: str = "ctu13_selected", limit: int = 0) -> DataFrame:
    """As read_flow_csv, with another preference among time columns."""
    return read_flow_csv(spark, path, limit, dataset_id, STREAM_TIMES)


def read_event_stream(spark: SparkSession, path: str, limit: int = 0, dataset_id: str = "lanl_comprehensive") -> DataFrame:
    """A headerless CSV of one of five kinds, known by the file's name, plain or gzip. Short rows lack the last columns; blank ones only count."""
    kind = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt")
    if kind not in STREAM_COLUMNS:
        raise ValueError(f"unsupported event stream: {kind}")
    names = STREAM_COLUMNS[kind]
    cells = csv_records(spark, path, blank_lines=True).where(F.exists("cells", lambda c: ~is_blank(c)))
    known = F.slice("cells", 1, len(names))
    fields = F.map_from_arrays(F.slice(F.array(*map(F.lit, names)), 1, F.size(known)), known)
    return raw_records(limited(cells, limit), dataset_id, f"lanl_{kind}_v1", fields=fields, timestamp=F.get("cells", F.lit(0)))


def read_event_xml(spark: SparkSession, path: str, limit: int = 0, dataset_id: str = "evtx_attack_samples") -> DataFrame:
    """Rendered event XML, one <Event> a row, numbered in file order; the payload has the header's fields and each named datum.

    The binary form of such files isn't read: no decoder of it comes with Spark.
    """
    data = "array<struct<_Name:string,_VALUE:string>>"
    schema = f"System struct<EventID:string,Computer:string,Channel:string,TimeCreated:struct<_SystemTime:string>>, EventData struct<Data:{data}>"
    events = spark.read.format("xml").option("rowTag", "Event").schema(schema).load(path)
    rows = numbered_rows(events, "System", "EventData")
    head = F.create_map(*[x for n in ("EventID", "Computer", "Channel") for x in (F.lit(n), F.col("System")[n])])
    named = F.map_from_entries(F.transform(F.filter(F.coalesce(F.col("EventData.Data"), F.array().cast(data)), lambda d: d["_Name"].isNotNull() & ~d["_Name"].isin("EventID", "Computer", "Channel")), lambda d: F.struct(d["_Name"], d["_VALUE"])))
    fields = F.map_filter(F.map_concat(head, named), lambda k, v: v.isNotNull())
    return raw_records(limited(rows, limit), dataset_id, "event_xml_v1", fields=fields, timestamp=F.col("System.TimeCreated._SystemTime"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad row fails the job. Otherwise it is kept in _corrupt_record with all else null. Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(dataset_id, source_file) of what lies under `root` and is read by read_discovered, by path.

    The listing of file names and sizes only; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("source_file"))
    name = F.element_at(F.split("source_file", "/"), -1)
    folder = F.element_at(F.split("source_file", "/"), -2)
    kind = F.when(F.col("source_file").contains("/sandworm/") & name.endswith("_labelled.csv"), "sandworm_flow")
    kind = kind.when((folder == "scenario_5") & ~name.endswith(".part"), "ctu13_selected").when(F.col("source_file").contains("/splunk_attack_data/") & name.endswith(".log"), "splunk_attack_data")
    return files.select(kind.alias("dataset_id"), "source_file").where("dataset_id is not null").orderBy("source_file")


def read_discovered(spark: SparkSession, root: str) -> DataFrame:
    """All discovered sources as one table, one read for each dataset. File names, not rows, come to the driver."""
    readers: dict[str, Callable] = {"sandworm_flow": read_csv_stream, "ctu13_selected": read_csv_stream, "splunk_attack_data": read_event_text}
    files: dict[str, list[str]] = {}
    for r in discover(spark, root).collect():
        files.setdefault(r.dataset_id, []).append(r.source_file)
    if not files:
        raise FileNotFoundError(f"no known source under {root}")
    return reduce(DataFrame.unionByName, [readers[d](spark, paths, dataset_id=d) for d, paths in files.items()])


#: dataset id -> reader (spark, path, limit) of raw records.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"loghub_2_0": read_text_log, "sandworm_flow": read_flow_csv, "evtx_attack_samples": read_event_xml, "lanl_comprehensive": read_event_stream}


def adapter_for(dataset_id: str) -> Callable[..., DataFrame]:
    if dataset_id not in ADAPTERS:
        raise ValueError(f"no reader for dataset {dataset_id!r}")
    return ADAPTERS[dataset_id]
