"""Rules over log lines, from frames to graphs."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.operators import entities, features, frames, graph, history, links, splits, templates, windows
from logweave.operators.parse import duplicate_counts, first_by_content, first_occurrence, parse

LOG = [
    ("2026-01-01T00:00:00Z", "User Alice logged in to Host-A success", "unknown", "success", {"actor": "Alice", "destination_host": "A"}),
    ("2026-01-01T00:01:00Z", "Process powershell.exe started on Host-A by User Alice", "process", "unknown", {"actor": "Alice", "destination_host": "A", "process": "powershell.exe"}),
    ("2026-01-01T00:03:00Z", "User Alice downloaded C:\\\\Users\\\\Alice\\\\tool.ps1 on Host-A", "file", "unknown", {"actor": "Alice", "destination_host": "A", "object": "C:\\\\Users\\\\Alice\\\\tool.ps1"}),
    ("2026-01-01T00:12:00Z", "Process powershell.exe connected to 203.0.113.10 from Host-A", "process", "unknown", {"destination_host": "A", "process": "powershell.exe", "destination_ip": "203.0.113.10"}),
    ("2026-01-01T00:23:00Z", "User Bob read /home/bob/notes.txt on Host-B", "file", "unknown", {"actor": "Bob", "destination_host": "B", "object": "/home/bob/notes.txt"}),
    ("2026-01-01T00:25:00Z", "login failed", "authentication", "failure", {}),
]


def raw(spark, rows):
    """Raw records from (time, text)."""
    df = spark.createDataFrame([("d", "f", i + 1, t, m) for i, (t, m) in enumerate(rows)], "dataset_id string, source_file string, source_line long, raw_timestamp string, payload_text string")
    return df.withColumns({"payload_map": F.lit(None).cast("map<string,string>"), "raw_record_id": F.lit(""), "source_hash": F.sha2("payload_text", 256)})


@pytest.fixture
def log_frames(spark):
    return frames.extract_frames(parse(raw(spark, [(r[0], r[1]) for r in LOG])))



def all_pairs_links(entities):
    """(source_window, target_window) by comparing every window with every other: the definition."""
    found = entities.collect()
    strong = {"user", "process", "host"}
    out = set()
    for a in found:
        for b in found:
            if a.entity_type in strong and (a.entity_type, a.value) == (b.entity_type, b.value) and (a.window_start, a.window_id) < (b.window_start, b.window_id):
                out.add((a.window_id, b.window_id))
    return sorted(out, key=str)


def test_frames_follow_the_ladder(log_frames):
    for r, (_, _, family, outcome, roles) in zip(log_frames.orderBy("source_line").collect(), LOG, strict=True):
        assert (r.action_family, r.outcome, r.roles) == (family, outcome, roles)
        assert (r.semantic_confidence, round(r.unknown_score, 2)) == ((0.35, 0.65) if family == "unknown" else (0.9, 0.1))


def test_parse_of_maps_and_empty_payloads(spark):
    df = raw(spark, [("t", None), (None, ""), ("t", " \u00a0")]).unionByName(raw(spark, [("t", None)]).withColumn("payload_map", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))))
    got = [(r.template_text, r.quarantine_reason, r.format) for r in parse(df).collect()]
    assert got == [("", "empty_payload", "text"), ("", "missing_timestamp", "text"), (" \u00a0", "empty_payload", "text"), ('{"a":"2","b":"1"}', None, "json")]


def test_keyword_frames_and_mentions(spark):
    t = ["failed login from 10.0.0.1 user=alice", "user=CORP\\alice wrote C:\\Temp\\a.exe and /etc/x, /etc/x", "nothing"]
    df = spark.createDataFrame([(x, 0.4) for x in t], "t string, c double")
    a, b, c = frames.keyword_frames(df, F.col("t"), F.col("c")).collect()
    assert (a.action, a.outcome, a.entities) == ("authenticate", "failure", ["10.0.0.1", "from", "alice"])
    assert b.entities == ["C:\\Temp\\a.exe", "/etc/x", "CORP\\alice"] and (b.actor, b.object) == ("C:\\Temp\\a.exe", "C:\\Temp\\a.exe")
    assert (c.action, c.semantic_confidence, c.quarantined_reason) == ("unknown", pytest.approx(0.3), "low_semantic_confidence")


def test_taxonomy_never_brings_labels(spark):
    f = spark.createDataFrame([("t1", {"own": "1", "x": "old"}), ("t2", None)], "template_id string, attributes map<string,string>")
    tax = spark.createDataFrame([("t1", {"x": "new", "target_Label": "bad"})], "template_id string, attributes map<string,string>")
    assert {r.template_id: r.attributes for r in frames.enrich(f, tax).collect()} == {"t1": {"own": "1", "x": "new"}, "t2": {}}


def test_default_frames(spark):
    rows = spark.createDataFrame([("d", "", "r1", "t")], "dataset_id string, record_id string, raw_record_id string, raw_timestamp string")
    r = frames.default_frames(rows).first()
    assert (r.record_id, r.timestamp, r.action_family, r.unknown_score, r.roles) == ("r1", "t", "unknown", 1.0, {})
    with pytest.raises(Exception, match="without record_id"):
        frames.default_frames(rows.withColumn("raw_record_id", F.lit(""))).collect()


def test_entity_types_and_scopes(spark, log_frames):
    found = entities.mention_entities(log_frames)
    got = {(r.raw_value, r.entity_type, r.canonical_value) for r in found.where("source_record_ref = 'f:3'").collect()}
    assert ("Alice", "user", "alice") in got and ("C:\\\\Users\\\\Alice\\\\tool.ps1", "file", "c:\\\\users\\\\alice\\\\tool.ps1") in got
    assert found.where("entity_type = 'process'").select("entity_id").distinct().count() == 2  # one each time
    assert {r.confidence for r in found.where("entity_type = 'ip'").collect()} == {0.4}
    assert entities.entities_of(found).where("entity_type = 'user' and canonical_value = 'alice'").first().mentions == 3
    blank = log_frames.limit(1).withColumn("entity_mentions", F.expr("array(named_struct('raw_value', ' ', 'role', 'actor'), named_struct('raw_value', cast(null as string), 'role', 'actor'))"))
    assert entities.mention_entities(blank).count() == 0


def test_simple_entities_and_aliases(spark):
    f = spark.createDataFrame([("r", ["10.0.0.1", "C:\\Temp\\Drop.exe", "CORP\\alice"])], "record_id string, entities array<string>")
    assert [(r.entity_type, r.canonical_value) for r in entities.resolve_values(f).orderBy("position").collect()] == [("ip", "10.0.0.1"), ("path", "c:/temp/drop.exe"), ("account", "corp/alice")]
    alias = spark.createDataFrame([("corp/alice", "account", " ALICE ")], "canonical_value string, entity_type string, alias string")
    assert entities.resolve_values(f, alias).where("position = 2").first().canonical_value == "alice"


def test_pair_scores(spark):
    e = lambda d, t, i: {"dataset_id": d, "entity_type": t, "entity_id": i}
    kind = "struct<dataset_id:string,entity_type:string,entity_id:string>"
    df = spark.createDataFrame([(0, e("d", "user", "a"), e("d", "user", "a")), (1, e("d", "ip", "a"), e("d", "ip", "a")), (2, e("d", "user", "a"), e("x", "user", "a")), (3, e("d", "user", "a"), e("d", "user", "b"))], f"n int, l {kind}, r {kind}")
    assert [(r.score, r.reason) for r in entities.score_pairs(df).orderBy("n").collect()] == [(1.0, "canonical_and_scope_match"), (0.0, "weak_ip_only"), (0.0, "scope_mismatch"), (0.0, "no_match")]


def test_dedup_keeps_the_first(spark, rows):
    df = raw(spark, [("t", "a"), ("t", "b"), ("t", "a")])
    assert rows(first_by_content(df), "source_line", "copies") == [(1, 2), (2, 1)]
    assert rows(first_occurrence(df, ["source_hash"], [F.col("source_line")]), "source_line") == [(1,), (2,)]
    assert rows(duplicate_counts(df)) == [("f", 3, 1)]


def test_templates(spark, tmp_path):
    df = spark.createDataFrame([("open port 1",), ("open  port 22",), ("close port 3 now",)], "text string")
    c = templates.catalog(templates.masked(df))
    assert sorted(r.size for r in c.collect()) == [1, 2]
    templates.save_catalog(c, str(tmp_path / "c"))
    assert templates.load_catalog(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="cache version"):
        templates.load_catalog(spark, str(tmp_path / "c"), "other").collect()
    many = spark.createDataFrame([("send mail to bob",), ("send mail to eve",), ("send x y z",)], "text string")
    got = {r.template: r.cluster_template for r in templates.merge_similar(templates.catalog(templates.masked(many)), 0.6).collect()}
    assert got["send mail to bob"] == got["send mail to eve"] == "send mail to <*>" and got["send x y z"] == "send x y z"


def test_strict_graph_counts(spark, log_frames):
    m = entities.mention_entities(log_frames)
    nodes, edges = graph.strict_graph(log_frames, entities.links_of(m))
    s = graph.graph_summary(nodes, edges).first()
    assert s.edge_count == m.count() and s.node_count == 6 + m.select("entity_id").distinct().count()
    assert s.relations == ["actor_of", "destination_of", "object_of", "process_of"] and s.score == s.edge_count / s.node_count
    typed, _ = graph.strict_graph(log_frames, entities.links_of(m), m)
    assert {r.node_type for r in typed.collect()} == {"event", "user", "host", "process", "file", "ip"}
    half = graph.known_edges(edges, nodes.where("node_type <> 'event'"))
    assert half.count() == 0


def test_weighted_graph_counts_edges(spark, rows):
    f = spark.createDataFrame([("r1", "read", "ok", "t1", 1), ("r1", "write", "bad", "t2", 2)], "record_id string, action string, outcome string, timestamp string, n int")
    e = spark.createDataFrame([("r1", "user:x", "user", "x")], "record_id string, entity_id string, entity_type string, canonical_value string")
    nodes, edges = graph.weighted_graph(f, e, ["n"])
    assert rows(edges.where("relation = 'participates'"), "source", "target", "weight", "timestamp") == [("user:x", "event:r1", 2.0, "t2")]
    assert rows(nodes.where("node_type = 'event'"), "node_id", "value", "outcome") == [("event:r1", "write", "bad")]
    assert graph.graph_bounds(f.withColumn("timestamp", F.lit(None).cast("string")), ["n"]).first().window_id.startswith("window:")


def test_tensors_and_neighbours(spark, rows):
    nodes = spark.createDataFrame([("b", "user"), ("a", "event")], "node_id string, node_type string")
    edges = spark.createDataFrame([("b", "a", "actor_of"), ("zz", "a", "actor_of")], "source string, target string, role string")
    index, arcs = graph.tensor_tables(nodes, edges, 4)
    assert rows(index, "node_index", "node_id") == [(0, "a"), (1, "b")] and rows(arcs) == [(1, 0, 0)]
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "node_id string, features array<double>")
    assert rows(graph.neighbor_mean(edges, v)) == [("a", [3.0, 4.0]), ("b", [0.0, 0.0])]


def test_event_graphs(spark, log_frames):
    g = graph.event_graphs(log_frames).where("size(edge_records) = 2").first()
    assert g.node_records[0].node_type == "event" and {e.role for e in g.edge_records} == {"actor_of"}
    m = spark.createDataFrame([("d", "r", [("x", "actor", None, None), ("y", "actor", "id", None)])], "dataset_id string, record_id string, mentions array<struct<raw_value:string,role:string,entity_id:string,entity_type:string>>")
    assert [tuple(n) for n in graph.entity_graphs(m).first().node_records] == [("id", "unknown")]


def test_history_is_strictly_before(spark, rows):
    e = spark.createDataFrame([("d", "b", "t1", "f", 2), ("d", "a", "t1", "f", 1), ("d", "c", "t2", "f", 1), ("d", "n", None, "f", 9)], "dataset_id string, record_id string, timestamp string, source_file string, source_line int")
    h = history.causal_history(e, ["dataset_id"], ["record_id"])
    assert {r.record_id: [x.record_id for x in r.history] for r in h.collect()} == {"n": [], "a": ["n"], "b": ["n", "a"], "c": ["n", "a", "b"]}
    assert rows(history.causal_history(e, ["dataset_id"], ["record_id"], 1), "record_id", "history_size") == [("a", 1), ("b", 2), ("c", 3), ("n", 0)]
    assert rows(history.history_before(e, "b"), "record_id") == [("a",), ("n",)]
    assert history.all_but(e, "b").count() == 3
    ok = h.select("record_id", "history", F.expr("array(named_struct('node_id', 'event:x'))").alias("graph_nodes"), F.expr("array(named_struct('source', 's', 'target', 'event:x'))").alias("graph_edges"))
    assert history.leaks(ok).count() == 0
    assert rows(history.leaks(ok.withColumn("record_id", F.when(F.col("record_id") == "c", "x").otherwise(F.col("record_id"))))) == [("x", "graph_node")]
    with pytest.raises(Exception, match="current event in its history"):
        history.require_no_leak(ok.withColumn("history", F.array(F.struct("record_id")))).collect()


@pytest.mark.parametrize(("last", "block"), [(1, 1), (3, 8), (40, 8)])
def test_ranged_history_is_the_ordered_one(spark, last, block):
    e = spark.range(90).selectExpr("if(id % 10 < 8, 'd', null) AS dataset_id", "cast(id AS string) AS record_id", "concat('t', id * 37 % 50) AS timestamp", "'f' AS source_file", "id AS source_line")
    a, b = (h(e, ["dataset_id"], ["record_id"], last, **more).collect() for h, more in ((history.causal_history, {}), (history.ranged_history, {"block": block})))
    assert sorted(a, key=str) == sorted(b, key=str) and max(r.history_size for r in b) == 71


def test_chains_connect_what_pairs_connect(spark):
    import random

    for seed, gap in ((0, 2), (1, 1), (2, 5)):
        r = random.Random(seed)
        w = window_set(spark, *[{t: r.sample("abcdefghij", 1) for t in ("user", "host", "ip") if r.random() < 0.5} or {"ip": ["a"]} for _ in range(24)])
        chains = links.anchor_chains(w, gap * 3600.0)
        assert chains.count() <= w.count()
        members = [sorted(map(tuple, links.attack_queues(x).collect()), key=str) for x in (chains, links.window_links(w, gap * 3600.0))]
        assert members[0] == members[1]


def window_set(spark, *sets):
    """(window_id, window_start, entity_type, value) rows; windows are hours."""
    rows = [(f"w{i}", f"2026-01-01 {i:02d}:00:00", t, v) for i, s in enumerate(sets) for t, vs in s.items() for v in vs]
    return spark.createDataFrame(rows, "window_id string, window_start string, entity_type string, value string").withColumn("window_start", F.to_timestamp("window_start"))


def test_ip_alone_links_nothing(spark, rows):
    w = window_set(spark, {"ip": ["1.1.1.1"], "user": ["a"]}, {"ip": ["1.1.1.1"], "user": ["b"]}, {"user": ["a"], "host": ["h"]}, {"host": ["h"], "process": ["h"]})
    assert rows(links.window_links(w, None), "source_window", "target_window", "anchors", "anchor_strength", "delta_seconds") == [("w0", "w2", ["a"], "strong", 7200.0), ("w2", "w3", ["h"], "medium", 3600.0)]
    p = links.window_pairs(w, None)
    assert rows(p.where("rejected_reason is not null"), "source_window", "target_window") == [("w0", "w1")]
    q = links.attack_queues(links.window_links(w, None)).collect()
    assert [(r.queue_id, r.window_ids) for r in q] == [("attack_queue_0000", ["w0", "w2", "w3"])]
    assert rows(links.window_links(w, 3600.0), "source_window", "target_window") == [("w2", "w3")]


def test_links_equal_all_pairs(spark, rows):
    import random

    for seed in range(3):
        r = random.Random(seed)
        w = window_set(spark, *[{t: r.sample("abcdefgh", 2) for t in ("user", "host", "process", "ip") if r.random() < 0.5} or {"ip": ["a"]} for _ in range(20)])
        assert rows(links.window_links(w, None), "source_window", "target_window", "n_strong", "n_medium") is not None
        ours = rows(links.window_links(w, None), "source_window", "target_window")
        assert ours == all_pairs_links(w)
        bounded = [(a, b) for a, b in ours if int(b[1:]) - int(a[1:]) <= 5]
        assert rows(links.window_links(w, 5 * 3600.0), "source_window", "target_window") == bounded


def test_windows(spark, rows):
    e = spark.createDataFrame([("d", "1", "2026-01-01 00:04:59", "read", 0.0), ("d", "2", "2026-01-01 00:05:00", "write", 0.0), ("d", "3", "2026-01-01 00:06:00", "read", 0.0)], "dataset_id string, record_id string, ts string, action_family string, logit double").withColumn("ts", F.to_timestamp("ts"))
    m = spark.createDataFrame([("2", "bob", "actor"), ("3", "bob", "actor"), ("3", "1.2.3.4", "object"), ("3", "/x", "other")], "record_id string, raw_value string, role string")
    v = spark.createDataFrame([("2", [1.0]), ("3", [3.0])], "record_id string, vector array<double>")
    w = windows.window_table(e, m, 5, score="logit", vectors=v, dim=2).orderBy("window_start").collect()
    assert [(r.event_count, r.actions, r.event_ids, r.suspicious_score) for r in w] == [(1, ["read"], ["1"], 0.5), (2, ["read", "write"], ["2", "3"], 0.5)]
    assert w[1].entities == {"user": ["bob"], "ip": ["1.2.3.4"], "unknown": ["/x"]} and w[1].embedding == [2.0, 0.0] and w[0].entities is None
    with pytest.raises(Exception, match="without a time"):
        windows.aggregate_windows(e.withColumn("ts", F.lit(None).cast("timestamp")), 5).collect()


def test_evidence(spark):
    w = window_set(spark, {"user": ["a", "b"]}, {"user": ["a", "b"]}, {"user": ["c"]})
    side = spark.createDataFrame([("w0", ["x"], ["p", "q"], [1.0, 0.0]), ("w1", ["x", "y"], ["q"], [0.0, 1.0])], "window_id string, actions array<string>, path_nodes array<string>, graph_embedding array<double>")
    e = links.link_evidence(links.window_links(w, None), side, links.entity_rarity(w)).first()
    assert (e.anchor_score, e.action_compatibility, e.path_coherence, e.graph_cosine) == (2.0, 1.0, 0.5, 0.0)
    assert e.stable_rarity == pytest.approx(0.405465, abs=1e-5)
    assert links.above(links.default_link_score(links.link_evidence(links.window_links(w, None), side)), 0.5).count() == 1
    assert [r.windows for r in links.entity_memory(w).orderBy("value").collect()] == [["w0", "w1"], ["w0", "w1"], ["w2"]]


def test_features(spark):
    f = spark.createDataFrame([("d", "1", "t", 0.9, 0.1, "ref")], "dataset_id string, record_id string, timestamp string, semantic_confidence double, unknown_score double, source_record_ref string")
    out = spark.createDataFrame([("d", "1", [1.0], 2.0, None)], "dataset_id string, record_id string, event_embedding array<double>, raw_event_logit double, slot_nll double")
    micro, macro = (spark.createDataFrame([("d", "1", x)], "dataset_id string, record_id string, score double") for x in (0.25, 0.75))
    r = features.join_features(f, out, micro, macro, hashes={"m": "h"}).first()
    assert (r.long_horizon_score, r.graph_embedding, r.graph_score, r.slot_nll, r.semantic_embedding, r.producer_artifact_hashes) == (0.75, [1.0], 0.0, 0.0, [0.9], {"m": "h"})
    with pytest.raises(Exception, match="incomplete feature join"):
        features.join_features(f, out, micro.limit(0), macro).collect()
    assert [x.missing for x in features.missing_inputs(f, {"micro": micro.limit(0), "macro": macro}).collect()] == ["micro"]
    assert features.forbidden_columns(spark.createDataFrame([({"Label": "1"}, 1)], "m map<string,string>, scenario int"), ("m",)) == ["scenario", "m"]
    with pytest.raises(PermissionError):
        features.assert_unlabeled(f.withColumn("label", F.lit(1)))
    j = features.join_features(f, out, micro, macro)
    assert not set(features.model_features(j).columns) & {"record_id", "dataset_id", "timestamp"}
    assert features.invalid_features(j).count() == 0 and features.invalid_features(j.withColumn("schema_version", F.lit(""))).count() == 1
    assert features.check_version(j).count() == 1
    with pytest.raises(Exception, match="schema version"):
        features.check_version(j.withColumn("schema_version", F.lit("v0"))).collect()
    assert features.frozen_export(f, {"a": "b"}).first().producer_artifact_hashes == {"a": "b"}
    with pytest.raises(Exception, match="without dataset_id"):
        features.frozen_export(f.withColumn("record_id", F.lit("")), {}).collect()
    assert features.window_rows(f).first().macro_minutes == 30


def test_splits(spark, rows):
    df = spark.createDataFrame([(f"r{i}", s) for s, n in (("a", 10), ("b", 1), ("c", 3)) for i in range(n)], "record_id string, source_dataset string")
    got = splits.source_held_out(df, "c").groupBy("source_dataset", "split").count()
    assert rows(got) == [("a", "train", 8), ("a", "validation", 2), ("b", "train", 1), ("c", "test", 3)]
    for bad, why in (("", "required"), ("x", "not found")):
        with pytest.raises(ValueError, match=why):
            splits.source_held_out(df, bad)
    with pytest.raises(ValueError, match="without"):
        splits.source_held_out(df.withColumn("source_dataset", F.lit("")), "c")
    ids = spark.createDataFrame([(x,) for x in "ebdca"], "record_id string")
    assert rows(splits.half_split(ids), "record_id", "split") == [("a", "train"), ("b", "train"), ("c", "validation"), ("d", "validation"), ("e", "validation")]
    with pytest.raises(ValueError, match="two rows"):
        splits.half_split(ids.limit(1))
    assert splits.hard_negatives(ids, 3).count() == 3 == splits.hard_negatives(ids, 3).intersect(splits.hard_negatives(ids, 3)).count()


def test_leakage(spark, rows):
    df = spark.createDataFrame([("r", "ait_lds", "f", "train", False), ("r", "x", "f", "test", True)], "record_id string, source_dataset string, source_file string, split string, label_used_for_training boolean")
    found = splits.leakage_findings(df)
    assert rows(found, "finding", "record_id") == [("duplicate_record_id", "r"), ("target_access", "r"), ("test_label_training", "r")]
    assert not splits.audit_passed(found) and splits.audit_passed(splits.leakage_findings(df.limit(0)))


def brute_clusters(templates, threshold):
    """(template) -> first member's template: join the first cluster, larger templates first, that agrees in enough places."""
    clusters = []
    for size, fp, t in sorted(templates, key=lambda x: (-x[0], x[1])):
        w = t.split()
        first = lambda x: "<*>" if re.search(r"\d|<", x) else x
        for c in clusters:
            same = sum(a == b for a, b in zip(c["words"], w, strict=False))
            if len(c["words"]) == len(w) and c["first"] == first(w[0] if w else "") and same >= threshold * max(1, len(w)):
                c["words"] = [a if a == b else "<*>" for a, b in zip(c["words"], w, strict=True)]
                c["members"].append(fp)
                break
        else:
            clusters.append({"words": w, "first": first(w[0] if w else ""), "members": [fp], "head": fp})
    return {m: (c["head"], " ".join(c["words"])) for c in clusters for m in c["members"]}


def test_similar_templates_by_brute_force(spark):
    lines = [f"{a} {b} host {c} took 7 ms {d}" for a in ("open", "close", "x1") for b in ("file", "port", "socket") for c in ("a", "b") for d in ("ok", "failed", "late")] + ["open it", "", "one"]
    found = templates.catalog(templates.masked(spark.createDataFrame([(x,) for x in lines for _ in range(1 + len(x) % 3)], "text string"))).cache()
    want = brute_clusters([(r["size"], r.fingerprint, r.template) for r in found.collect()], 0.7)
    got = {r.fingerprint: (r.cluster, r.cluster_template) for r in templates.merge_similar(found, 0.7).collect()}
    assert got == want and len({c for c, _ in got.values()}) > 5
    few = {r.fingerprint: r.cluster for r in templates.merge_similar(found, 0.2).collect()}
    assert few == {k: c for k, (c, _) in brute_clusters([(r["size"], r.fingerprint, r.template) for r in found.collect()], 0.2).items()}


def test_registered_template_clusters_by_brute_force(spark):
    from logweave.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/conversations.parquet").select(F.explode(F.split("text", "\n")).alias("text"))
    found = templates.catalog(templates.masked(lines)).collect()
    want = brute_clusters([(r["size"], r.fingerprint, r.template) for r in found], 0.4)
    got = {r.fingerprint: (r.cluster, r.cluster_sha256) for r in QUERIES["template_clusters"](spark, folder).collect()}
    assert got == {k: (c, hashlib.sha256(t.encode()).hexdigest()) for k, (c, t) in want.items()}


def test_history_within_a_time_equals_the_theta_join(spark):
    from logweave.operators.history import history_within

    rng = random.Random(6)
    data = [(i, rng.choice("ab"), rng.choice([None, *range(0, 5000, 50), *[1000] * 60]), i % 7) for i in range(400)]  # a burst at one time
    e = spark.createDataFrame(data, "i long, k string, s long, x long").withColumn("ts", F.col("s").cast("timestamp"))
    got = {r.i: [h.i for h in r.history] for r in history_within(e, ["k"], ["i"], 600.0, ["s", "i"]).collect()}
    for i, k, s, _ in data:
        want = sorted((y, j) for j, z, y, _ in data if z == k and s is not None and y is not None and (y, j) < (s, i) and s - y <= 600)
        assert got[i] == [j for _, j in want]


def test_neighbours_are_summed_in_one_row_a_node(spark, rows):
    v = spark.createDataFrame([("a", [1.0, None, 5.0]), ("b", [3.0]), ("c", []), ("d", None)], "node_id string, features array<double>")
    edges = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "d")], "source string, target string")
    got = graph.neighbor_mean(edges, v)
    assert rows(got) == [("a", [2.0, None, 5.0]), ("b", [3.0]), ("c", []), ("d", [1.0, None, 5.0])]
    assert "posexplode" not in got._jdf.queryExecution().toString()


def test_numbering_pins_no_features_and_moves_rows_once(spark, monkeypatch):
    from logweave.operators import numbering

    pinned, plain = [], numbering.pin_table
    monkeypatch.setattr(numbering, "pin_table", lambda df, name: pinned.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    nodes = spark.createDataFrame([("b", "user"), ("a", "event")], "node_id string, node_type string")
    index, _ = graph.tensor_tables(nodes, spark.createDataFrame([("b", "a", "r")], "source string, target string, role string"), 4)
    assert pinned[0][0] == ["node_id", "node_type", "__id"] and index.columns == ["node_id", "type_id", "features", "node_index"]
    numbering_plan = numbering.dense_position(spark.range(9), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in numbering_plan


def test_each_link_set_is_computed_once(spark, rows, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("w1", "w2"), ("w2", "w3")], "source_window string, target_window string").mapInArrow(counted, "source_window string, target_window string")
    truth = spark.createDataFrame([("w1", "x"), ("w2", "x"), ("w3", "y")], "window_id string, label string")
    assert rows(links.link_quality({"a": pairs}, truth)) == [("a", 2, 1, 0.5)] and calls.value == 2
