"""Registered queries of readers, sinks and streams: a table is written in a format and read back, or streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.text import iso_time
from logweave.operators import links, parse, sinks, templates
from logweave.operators.campaign_store import CampaignStore
from logweave.operators.pinning import new_table_path, pin_table
from logweave.plans.campaigns import DAY, user_windows
from logweave.plans.events import event_frames, table
from logweave.plans.log_pipeline import run_log_pipeline
from logweave.plans.queries import event_stream, query, raw_documents
from logweave.sources import raw
from logweave.sources.readers import adapter_for, read_csv_stream, read_discovered, read_event_stream, read_event_text, read_event_xml, read_flow_csv, read_text_log, read_timed_text
from logweave.streaming import jobs
from logweave.streaming.tail import tail_records, tailed_records

#: How long a window stays in the campaign store of the registered query.
KEEP_DAYS = 10
CSV = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _iso(ts: str) -> F.Column:
    return F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _text_folder(df: DataFrame, name: str) -> str:
    path = new_table_path(df.sparkSession, name)
    df.write.text(path, lineSep="\n")
    return path


def _xml_folder(events: DataFrame, path: str) -> str:
    """Rendered events (event_id, value) as files, a thousand to a file."""
    files = events.groupBy((F.col("event_id") / 1000).cast("long").alias("file")).agg(F.concat(F.lit("<Events>"), F.array_join(F.collect_list("value"), ""), F.lit("</Events>")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """documents as CSV and read back: whole texts with their line breaks in quotes, a name over two lines, an unnamed column, empty cells; every second row lacks the first choice of time."""
    path = new_table_path(spark, "csv_source")
    d = table(spark, sf, "documents")
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("t"), "doc_id")).otherwise("")
    cells = d.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("the\nnote"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("").alias(""), first.alias("timestamp"), F.concat(F.lit("s"), "doc_id").alias("StartTime"))
    cells.write.options(**CSV).csv(path)
    m = F.col("payload_map")
    return read_flow_csv(spark, path).select(m["doc_id"].cast("long").alias("doc_id"), F.sha2(m["the\nnote"].cast("binary"), 256).alias("note_sha256"), m[""].alias("unnamed"), "raw_timestamp", F.size("payload_map").cast("long").alias("n_fields"))


@query
def adapter_sources(spark: SparkSession, sf: str) -> DataFrame:
    """events as four kinds of files, each read by the reader of its dataset to the one kind of record."""
    root, e = new_table_path(spark, "adapters"), table(spark, sf, "events").withColumn("id", F.col("event_id").cast("string"))
    e.select(F.concat_ws(" ", "id", "event_type").alias("value")).write.text(f"{root}/text")
    e.select("id", _iso("ts").alias("Timestamp")).write.options(**CSV).csv(f"{root}/flow")
    e.select(F.concat_ws(",", "id", "event_type", F.lit("c")).alias("value")).write.text(f"{root}/dns.txt")
    _xml_folder(e.select("event_id", F.format_string("<Event><System><EventID>%s</EventID><Computer>c</Computer></System></Event>", "id").alias("value")), f"{root}/xml")
    read = lambda dataset, name: adapter_for(dataset)(spark, f"{root}/{name}").select(*raw.RAW)
    m = F.col("payload_map")
    found = read("loghub_2_0", "text").unionByName(read("sandworm_flow", "flow")).unionByName(read("lanl_comprehensive", "dns.txt")).unionByName(read("evtx_attack_samples", "xml"))
    event = F.coalesce(F.substring_index("payload_text", " ", 1), m["id"], m["time"], m["EventID"]).cast("long")
    return found.select("dataset_id", event.alias("event_id"), "format", "adapter_version", F.coalesce("raw_timestamp", F.lit("")).alias("time"), (F.length("raw_record_id") > 0).alias("has_id"))


@query
def csv_stream_source(spark: SparkSession, sf: str) -> DataFrame:
    """orders as a flow table whose start time goes before its own timestamp."""
    path = new_table_path(spark, "csv_stream")
    o = table(spark, sf, "orders")
    o.select(F.col("o_orderkey").cast("string").alias("flow"), F.lit("late").alias("timestamp"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("k"), "o_orderkey")).otherwise("").alias("StartTime")).write.options(**CSV).csv(path)
    return read_csv_stream(spark, path).select(F.col("payload_map")["flow"].cast("long").alias("o_orderkey"), "raw_timestamp", "dataset_id", "format")


@query
def headerless_stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a headerless stream of processes, known by its name; every fourth row is short."""
    e = table(spark, sf, "events")
    cells = F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("c1"), F.col("event_type"), F.when(F.col("event_id") % 4 > 0, F.lit("Start")))
    path = f"{new_table_path(spark, 'streams')}/proc.txt"
    e.select(cells.alias("value")).write.text(path)
    p = read_event_stream(spark, path).select("raw_timestamp", F.col("payload_map").alias("m"))
    return p.select(F.col("raw_timestamp").cast("long").alias("event_id"), F.col("m")["user"].alias("user"), F.col("m")["process"].alias("process"), F.coalesce(F.col("m")["action"], F.lit("")).alias("action"), F.size("m").cast("long").alias("n_fields"))


@query
def event_xml_source(spark: SparkSession, sf: str) -> DataFrame:
    """events as rendered XML, a thousand to a file, and read back."""
    head = F.format_string("<Event><System><EventID>%s</EventID><Computer>c</Computer><Channel>%s</Channel><TimeCreated SystemTime='%s'/></System>", F.col("event_id").cast("string"), F.col("event_type"), _iso("ts"))
    data = F.format_string("<EventData><Data Name='User'>%s</Data><Data Name='EventID'>own</Data></EventData></Event>", F.col("user_id").cast("string"))
    path = _xml_folder(table(spark, sf, "events").select("event_id", F.concat(head, data).alias("value")), new_table_path(spark, "xml"))
    m = F.col("payload_map")
    return read_event_xml(spark, path).select(m["EventID"].cast("long").alias("event_id"), m["Channel"].alias("channel"), m["User"].alias("user"), "raw_timestamp", F.size(m).cast("long").alias("n_fields"))


@query
def discovered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """customers and suppliers as files of a known folder, with headers of their own: found and read as one table."""
    root = new_table_path(spark, "discovered")
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("StartTime"), F.col("c_name").alias("name")).write.options(**CSV).csv(f"{root}/a/scenario_5")
    table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("StartTime"), F.lit("x").alias("more")).write.options(**CSV).csv(f"{root}/b/scenario_5")
    return read_discovered(spark, root).select("dataset_id", "raw_timestamp", F.col("payload_map")["name"].alias("name"), F.size("payload_map").cast("long").alias("n_fields"))


@query
def timed_text(spark: SparkSession, sf: str) -> DataFrame:
    """events as lines that begin with their time, but for every fifth."""
    line = F.concat(F.when(F.col("event_id") % 5 > 0, F.concat(_iso("ts"), F.lit(" "))).otherwise(""), F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    found = read_timed_text(spark, _text_folder(table(spark, sf, "events").select(line.alias("value")), "timed"), "events")
    return found.select(F.col("payload_text").alias("message"), F.coalesce("raw_timestamp", F.lit("")).alias("time"))


@query
def event_text_times(spark: SparkSession, sf: str) -> DataFrame:
    """events as lines that state a time in one of three ways."""
    stated = F.element_at(F.array(F.concat(F.lit("TimeCreated x SystemTime='"), _iso("ts"), F.lit("'")), F.concat(F.lit("timestamp="), _iso("ts")), F.lit("none")), (F.col("event_id") % 3 + 1).cast("int"))
    found = read_event_text(spark, _text_folder(table(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(", "), stated).alias("value")), "event_text"))
    return found.select(F.substring_index("payload_text", ",", 1).cast("long").alias("event_id"), F.coalesce("raw_timestamp", F.lit("")).alias("time"))


@query
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as lines of files: each file's up to its first non-blank line of number 3 or more, and of those the first 500."""
    c = table(spark, sf, "conversations").select(F.concat(F.lit("f"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("source_file"), F.col("turn").cast("long").alias("source_line"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(" ").alias("value"))
    return raw.limited(raw.first_physical_lines(c, 3), 500).select("source_file", "source_line")


@query
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of events with Z, with an offset, bare, and none."""
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.element_at(F.array(F.concat(t, F.lit("Z")), F.concat(t, F.lit("+02:00")), t, F.concat(F.lit("at "), t)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.date_format(iso_time(text), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("time"))


# Sinks


@query
def quarantine_append(spark: SparkSession, sf: str) -> DataFrame:
    """Quarantined documents appended in two turns, the second of them twice, and read back."""
    path, p = new_table_path(spark, "quarantine"), parse.parse(raw_documents(spark, sf))
    for k in (0, 1, 1):
        sinks.append_quarantine(p.where(F.col("source_line") % 2 == k), path, k)
    return sinks.committed(spark, path, "quarantine").select("record_id", "source_line", "quarantine_reason")


@query
def split_output(spark: SparkSession, sf: str) -> DataFrame:
    """Parses written by quarantine: what is in each folder, beside the counts that the writer gives."""
    path = new_table_path(spark, "split")
    n = sinks.write_split(parse.parse(raw_documents(spark, sf)), path)
    by = spark.read.parquet(path).groupBy(F.col("quarantined").cast("string").alias("quarantined")).agg(F.count("*").alias("rows"), F.countDistinct("record_id").alias("ids"))
    return by.withColumn("counted", F.when(F.col("quarantined") == "true", F.lit(n["quarantined"])).otherwise(F.lit(n["valid"])).cast("long"))


@query
def stage_run(spark: SparkSession, sf: str) -> DataFrame:
    """A stage that keeps English documents: its manifest, and the digest of what it wrote against that of the rows."""
    path, d = new_table_path(spark, "stage"), table(spark, sf, "documents").select("doc_id", "lang", "source")
    m = sinks.run_stage(d, "english", lambda x: x.where("lang = 'en'"), path)
    same = sinks.content_digest(d.where("lang = 'en'"))
    return m.select("stage", "input_count", "output_count", "rejected_count", (F.element_at(F.map_values("outputs"), 1) == same).alias("unchanged"), "schema_version")


@query
def operation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Operations on customers' segments, logged one by one and read back."""
    path = new_table_path(spark, "operations")
    for r in table(spark, sf, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect():  # a row for each of the few segments
        sinks.append_operation(spark, path, r.c_mktsegment, "ok", {"rows": str(r["count"])})
    log = spark.read.schema("timestamp_utc string, operation string, status string, details map<string,string>").json(path)
    return log.select("operation", "status", F.col("details")["rows"].cast("long").alias("rows"), F.col("timestamp_utc").isNotNull().alias("timed"))


@query
def link_export(spark: SparkSession, sf: str) -> DataFrame:
    """Links, queues and values of error windows, exported and counted as read back."""
    root, seen = new_table_path(spark, "export"), pin_table(user_windows(spark, sf), "user_windows")
    sinks.export_links(links.window_links(seen, DAY), links.attack_queues(links.anchor_chains(seen, DAY)), links.suspicious_values(seen), root)
    counted = lambda name, schema, key: spark.read.schema(schema).json(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
    return counted("window_links", "source_window string", "source_window").unionByName(counted("attack_queues", "queue_id string", "queue_id")).unionByName(counted("suspicious_nodes", "value string", "value"))


@query
def catalog_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of masked conversations, saved with its version and loaded."""
    path = new_table_path(spark, "catalog")
    templates.save_catalog(templates.catalog(templates.masked(table(spark, sf, "conversations"))), path)
    c = templates.load_catalog(spark, path)
    return c.select("fingerprint", "size", F.sha2(F.col("template").cast("binary"), 256).alias("template_sha256"))


@query
def prediction_export(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "predictions")
    sinks.export_predictions(table(spark, sf, "labels").select(F.col("doc_id").alias("record_id"), (F.col("quality") * 0.5 + 0.25).cast("double").alias("score")), path)
    return spark.read.schema("record_id long, score double").json(path)


@query
def log_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as a log of timed lines through the whole chain of a log: its attack queues."""
    line = F.concat(_iso("ts"), F.lit(" User u"), F.col("user_id").cast("string"), F.lit(" failed to read item "), F.col("event_id").cast("string"))
    path = _text_folder(table(spark, sf, "events").where("event_type = 'error'").select(line.alias("value")), "log")
    q = run_log_pipeline(spark, path, "events").queues
    return q.select("queue_id", F.size("window_ids").cast("long").alias("windows"), F.element_at("window_ids", 1).alias("first_window"), F.element_at("window_ids", -1).alias("last_window"))


# Streams


@query
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    """events as lines in files that a stream tails: valid ones one way, those without a time or message another, over several micro-batches."""
    e = table(spark, sf, "events")
    line = F.concat(F.when(F.col("event_id") % 6 > 0, F.concat(_iso("ts"), F.lit(" "))).otherwise(""), F.lit("event "), F.col("event_id").cast("string"))
    path, out = _text_folder(e.select(line.alias("value")).repartition(4), "tail"), new_table_path(spark, "tailed")
    writer = jobs.with_quarantine(jobs.tail_text(spark, path, "events", files_per_batch=1), out, new_table_path(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()
    both = sinks.committed(spark, out, "valid").unionByName(sinks.committed(spark, out, "quarantine"))
    return both.select("message", F.coalesce("timestamp", F.lit("")).alias("time"), F.coalesce("quarantine_reason", F.lit("")).alias("reason"))


@query
def tailed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """events as lines that a tail follows by bytes over two runs, with new files between them: each record, and whether a batch read gives it the same id and hash."""
    line = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    path, root, state = new_table_path(spark, "followed"), new_table_path(spark, "tailed"), new_table_path(spark, "stream")
    for k in range(2):
        table(spark, sf, "events").where(F.col("event_id") % 2 == k).select(line.alias("value")).write.mode("append").text(path, lineSep="\n")
        tail_records(spark, path, root, state).trigger(availableNow=True).start().awaitTermination()
    batch = read_text_log(spark, path).select("raw_record_id", F.col("source_hash").alias("hash"))
    both = tailed_records(spark, root).join(batch, "raw_record_id", "left")
    return both.select(F.col("payload_text").alias("message"), F.coalesce(F.col("hash") == F.col("source_hash"), F.lit(False)).alias("same"))


@query
def stream_entity_spans(spark: SparkSession, sf: str) -> DataFrame:
    """First and last time and mentions of each user through a stream, kept up to date over micro-batches; its last word."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = event_stream(spark, sf).select(F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("value"), "ts")
    out = jobs.run_once(jobs.entity_spans(s), f"stream_spans_{id(s)}", new_table_path(spark, "stream"), "update")
    last = out.groupBy("entity_type", "value").agg(F.max(F.struct("mentions", "first_seen", "last_seen")).alias("x"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return last.select("entity_type", "value", when("x.first_seen").alias("first_seen"), when("x.last_seen").alias("last_seen"), "x.mentions")


@query
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users through a stream of several batches, over whose borders they go on; in complete mode, so that open ones are out too."""
    e = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("user"), "ts")
    s = jobs.session_counts(e, "user", "30 minutes")
    s = jobs.run_once(s, f"stream_sessions_{id(s)}", new_table_path(spark, "stream"), "complete")
    return s.select("user", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "event_count")


@query
def stream_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """Error windows by user as a stream of four batches, kept for ten days: the campaigns at its end, as from all live windows at once."""
    path = new_table_path(spark, "window_stream")
    seen = pin_table(user_windows(spark, sf), "user_windows")
    parts = F.least(F.floor(F.percent_rank().over(Window.orderBy("window_start")) * 4), F.lit(3)).alias("part")
    days = pin_table(seen.select(F.to_date("window_start").alias("window_start")).distinct().select("window_start", parts), "stream_days")
    for k in range(4):
        seen.join(days.where(F.col("part") == k).select(F.col("window_start").alias("day")), F.to_date("window_start") == F.col("day")).drop("day").coalesce(1).write.mode("append").parquet(path)
    store = CampaignStore(spark, new_table_path(spark, "campaign_store"), DAY, KEEP_DAYS * DAY)
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.campaign_stream(stream, store, new_table_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    q = store.queues()
    return q.select("root", F.size("window_ids").cast("long").alias("windows"), F.element_at("window_ids", -1).alias("last_window"))
