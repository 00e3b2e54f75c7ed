"""SQL of the queries of readers, sinks, streams, guards and releases."""

from __future__ import annotations

from logweave.plans import oracle
from logweave.plans.oracle import FRAMES, LINKS, MASKED, RAW, _start, _window

SQL: dict[str, str] = {}
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

SQL["csv_source"] = """
SELECT doc_id, sha256(coalesce(text, '')) AS note_sha256, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS unnamed, CASE WHEN doc_id % 2 = 0 THEN 't' ELSE 's' END || doc_id AS raw_timestamp, 5::BIGINT AS n_fields FROM documents"""
SQL["adapter_sources"] = f"""
SELECT dataset_id, event_id, CASE WHEN version = 'loghub_text_v1' THEN 'text' ELSE 'json' END AS format, version AS adapter_version,
  CASE version WHEN 'csv_stream_v1' THEN {_ISO} WHEN 'lanl_dns_v1' THEN event_id::VARCHAR ELSE '' END AS time, true AS has_id
FROM events, (VALUES ('loghub_2_0', 'loghub_text_v1'), ('sandworm_flow', 'csv_stream_v1'), ('lanl_comprehensive', 'lanl_dns_v1'), ('evtx_attack_samples', 'event_xml_v1')) v(dataset_id, version)"""
SQL["csv_stream_source"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'k' || o_orderkey ELSE 'late' END AS raw_timestamp, 'ctu13_selected' AS dataset_id, 'json' AS format FROM orders"""
SQL["headerless_stream"] = """
SELECT event_id, user_id::VARCHAR AS "user", event_type AS process, CASE WHEN event_id % 4 > 0 THEN 'Start' ELSE '' END AS action, CASE WHEN event_id % 4 > 0 THEN 5 ELSE 4 END::BIGINT AS n_fields FROM events"""
SQL["event_xml_source"] = f"""SELECT event_id, event_type AS channel, user_id::VARCHAR AS "user", {_ISO} AS raw_timestamp, 4::BIGINT AS n_fields FROM events"""
SQL["discovered_sources"] = """
SELECT 'ctu13_selected' AS dataset_id, c_custkey::VARCHAR AS raw_timestamp, c_name AS name, 2::BIGINT AS n_fields FROM customer
UNION ALL SELECT 'ctu13_selected', s_suppkey::VARCHAR, s_name, 3 FROM supplier"""
SQL["timed_text"] = f"SELECT 'event ' || event_id || ' ' || event_type AS message, CASE WHEN event_id % 5 > 0 THEN {_ISO} ELSE '' END AS time FROM events"
SQL["event_text_times"] = f"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN {_ISO} ELSE '' END AS time FROM events"
SQL["first_lines"] = r"""
WITH c AS (SELECT 'f' || lpad(conv_id::VARCHAR, 9, '0') AS source_file, turn::BIGINT AS source_line FROM conversations WHERE turn % 2 = 1 AND regexp_matches(text, '\S')),
s AS (SELECT source_file, min(source_line) AS stop FROM c WHERE source_line >= 3 GROUP BY 1)
SELECT source_file, source_line FROM c LEFT JOIN s USING (source_file) WHERE source_line <= coalesce(stop, source_line) ORDER BY source_file, source_line LIMIT 500"""
SQL["iso_times"] = """
SELECT event_id, CASE event_id % 4 WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time FROM events"""

SQL["quarantine_append"] = f"WITH {RAW} SELECT record_id, source_line, reason AS quarantine_reason FROM parsed WHERE reason IS NOT NULL"
SQL["split_output"] = f"""
WITH {RAW} SELECT (reason IS NOT NULL)::VARCHAR AS quarantined, count(*) AS rows, count(DISTINCT record_id) AS ids, count(*) AS counted FROM parsed GROUP BY 1"""
SQL["stage_run"] = """
SELECT 'english' AS stage, count(*) AS input_count, count(*) FILTER (WHERE lang = 'en') AS output_count, count(*) - count(*) FILTER (WHERE lang = 'en') AS rejected_count, TRUE AS unchanged, 'v3-contract-1' AS schema_version FROM documents"""
SQL["operation_log"] = "SELECT c_mktsegment AS operation, 'ok' AS status, count(*) AS rows, TRUE AS timed FROM customer GROUP BY c_mktsegment"
SQL["link_export"] = f"""
WITH RECURSIVE {LINKS},
b AS (SELECT source_window AS a, target_window AS z FROM l UNION SELECT target_window, source_window FROM l),
reach AS (SELECT a, a AS z FROM b UNION SELECT r.a, b.z FROM reach r JOIN b ON b.a = r.z),
roots AS (SELECT DISTINCT min(z) AS root FROM reach GROUP BY a)
SELECT 'window_links' AS name, count(*) AS rows, count(DISTINCT source_window) AS keys FROM l
UNION ALL SELECT 'attack_queues', count(*), count(*) FROM roots UNION ALL SELECT 'suspicious_nodes', count(DISTINCT value), count(DISTINCT value) FROM u"""
SQL["catalog_roundtrip"] = f"""
WITH {MASKED.replace("documents", "conversations").replace("doc_id", "conv_id")}
SELECT fingerprint, count(*) AS size, sha256(min(template)) AS template_sha256 FROM printed GROUP BY fingerprint"""
SQL["prediction_export"] = "SELECT doc_id AS record_id, (quality * 0.5 + 0.25)::DOUBLE AS score FROM labels"

SQL["log_pipeline"] = oracle.SQL["attack_queues"]
SQL["stream_tail"] = f"""
SELECT 'event ' || event_id AS message, CASE WHEN event_id % 6 > 0 THEN {_ISO} ELSE '' END AS time, CASE WHEN event_id % 6 > 0 THEN '' ELSE 'missing_timestamp' END AS reason FROM events"""
SQL["tailed_lines"] = "SELECT 'event ' || event_id AS message, TRUE AS same FROM events"
SQL["stream_entity_spans"] = """
SELECT 'user' AS entity_type, user_id::VARCHAR AS value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS mentions FROM events GROUP BY user_id"""
SQL["stream_sessions"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id::VARCHAR AS "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS event_count FROM s GROUP BY user_id, n"""

_JSON = """'{"' || {0} || 'priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'"""
SQL["json_payload_ids"] = f"""
WITH j AS (SELECT o_orderkey, {_JSON.replace("{0}", "'key\":\"' || o_orderkey || '\",\"'")} AS whole, {_JSON.replace("{0} ||", "")} AS settings FROM orders)
SELECT o_orderkey, whole AS payload_json, sha256(whole) AS source_hash, sha256(settings) AS config_hash FROM j"""
SQL["epoch_windows"] = "SELECT event_id, (epoch_us(ts) // 300000000)::BIGINT AS micro, (epoch_us(ts) // 1800000000)::BIGINT AS macro FROM events"
SQL["rule_labels"] = "SELECT c_custkey, contains(c_name, '7')::INT AS label FROM customer"
SQL["weighted_scores"] = "SELECT doc_id, round((0.5 * quality - 0.25 * toxic + doc_id % 10) / 1.25, 9) AS score FROM labels"
SQL["rule_entities"] = """
WITH c AS (SELECT c_name AS raw_value, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'unknown' END AS entity_type, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END AS canonical_value FROM customer)
SELECT *, 0.5::DOUBLE AS confidence, 'rule' AS resolution_method, sha256('c|' || entity_type || '|' || canonical_value || '|') AS entity_id FROM c"""
SQL["entity_event_graphs"] = f"""
WITH {FRAMES} SELECT record_id, concat_ws(',', 'user/' || actor, CASE WHEN event_id % 2 = 0 THEN 'unknown/' || k END) AS nodes FROM f"""
SQL["frozen_features"] = f"""
WITH {FRAMES} SELECT record_id, 'a=b,events=given' AS producers, 'v3-contract-1' AS schema_version, 'value' AS model_columns, round(value, 6) AS value FROM f"""
SQL["unversioned_features"] = "SELECT event_id::VARCHAR AS record_id, 'missing_version' AS reason FROM events WHERE event_id % 11 = 0"
SQL["label_columns"] = "SELECT 'Label' AS name UNION ALL SELECT 'more' FROM customer WHERE c_custkey = 7"
SQL["window_row_sizes"] = f"WITH {FRAMES} SELECT record_id, timestamp, 5 AS micro_minutes, 30 AS macro_minutes FROM f"
SQL["window_evidence"] = f"""
WITH w AS (SELECT *, {_start(5)} AS start FROM events)
SELECT {_window(5)} AS window_id, count(*) AS event_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions FROM w GROUP BY start"""
SQL["links_above"] = f"""
WITH {LINKS}, s AS (SELECT source_window, target_window, 1 / (1 + exp(-(-1.0 + len(anchors) + 1.5 + exp(-delta / 3600.0 / 6)))) AS score FROM l)
SELECT source_window, target_window, round(score, 6) AS score FROM s WHERE score >= 0.85"""

SQL["release_selection"] = """
SELECT c_custkey::VARCHAR AS dataset_id, c_mktsegment AS tier, CASE WHEN c_custkey % 3 = 0 THEN sha256(c_custkey::VARCHAR) ELSE '' END AS local_sha256 FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (1, 2)"""
SQL["release_gaps"] = """
WITH have AS (SELECT DISTINCT ['RELEASE_LOCKED', 'thresholds.json', 'calibration.json'][n_regionkey % 3 + 1] AS name FROM nation)
SELECT name FROM (SELECT unnest(['RELEASE_LOCKED', 'thresholds.json', 'calibration.json', 'model_hashes.json', 'release_manifest.json', 'checkpoints/%.pt']) AS name) WHERE name NOT IN (SELECT name FROM have)"""
SQL["sealed_predictions"] = "SELECT 'PREDICTIONS_SEALED' AS status, 'r1' AS release_id, '/p/' || doc_id AS path, sha256(text) AS sha256 FROM documents"
SQL["file_audit"] = """
SELECT coalesce(source, 'none') AS source, 65 * count(*) AS bytes, sha256(string_agg(sha256(text) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1"""
SQL["stage_summary"] = """
WITH m AS (SELECT strftime(o_orderdate::DATE, '%Y-%m') AS month, date_trunc('month', o_orderdate::DATE) AS start, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.month AS stage, a.n AS input_count, a.n AS output_count, 0::BIGINT AS rejected_count, b.month IS NULL OR a.n % 5 <> 0 AS upstream_unchanged FROM m a LEFT JOIN m b ON b.start = a.start - INTERVAL 1 MONTH"""
SQL["stream_campaigns"] = "WITH RECURSIVE " + oracle.QUEUES.replace("u AS (", "everyone AS (", 1).replace("\nl AS (", "\nu AS (SELECT * FROM everyone WHERE start >= (SELECT max(start) FROM everyone) - INTERVAL 10 DAY),\nl AS (", 1) + """
SELECT root, count(*) AS windows, max(id) AS last_window FROM named GROUP BY root"""
_ASOF = """
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT DISTINCT user_id, ts AS start FROM events WHERE event_type = 'signup'),
m AS (SELECT e.*, s.start FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.start)"""
SQL["detection_delays"] = _ASOF + """
SELECT s.user_id, strftime(s.start, '%Y-%m-%d %H:%M:%S.%f') AS start, round((epoch_us(min(m.ts)) - epoch_us(s.start)) / 1e6, 4) AS delay_seconds
FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.start = s.start AND epoch_us(m.ts) - epoch_us(m.start) <= 86400000000 GROUP BY s.user_id, s.start"""
SQL["false_alerts"] = _ASOF + """
SELECT count(*) AS alerts, count(*) FILTER (WHERE wrong) AS false_alerts, round(count(*) FILTER (WHERE wrong) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600), 6) AS per_hour
FROM (SELECT *, start IS NULL OR epoch_us(ts) - epoch_us(start) > 3600000000 AS wrong FROM m)"""
SQL["link_baselines"] = f"""
WITH x AS (SELECT {_window(5)} AS id, start, user_id::VARCHAR AS actor, json_extract_string(props, '$.k') AS k, event_type FROM (SELECT *, {_start(5)} AS start FROM events)),
u AS (SELECT DISTINCT id, start, 'user' AS kind, actor AS value FROM x UNION SELECT DISTINCT id, start, 'file', k FROM x WHERE k IS NOT NULL),
w AS (SELECT *, lead(id) OVER o AS nxt, lead(start) OVER o AS nxt_start FROM (SELECT DISTINCT id, start FROM u) WINDOW o AS (ORDER BY start, id)),
l AS (
  SELECT 'time' AS links, id AS a, nxt AS b FROM w WHERE epoch(nxt_start) - epoch(start) <= 3600
  UNION SELECT 'any', p.id, q.id FROM u p JOIN u q ON p.kind = q.kind AND p.value = q.value AND (p.start, p.id) < (q.start, q.id) AND epoch(q.start) - epoch(p.start) <= 3600
  UNION SELECT 'stable', p.id, q.id FROM u p JOIN u q ON p.kind = 'user' AND q.kind = 'user' AND p.value = q.value AND (p.start, p.id) < (q.start, q.id) AND epoch(q.start) - epoch(p.start) <= 3600),
t AS (SELECT DISTINCT id, actor AS label FROM x WHERE event_type = 'error'),
r AS (SELECT DISTINCT l.* FROM l JOIN t c ON c.id = l.a JOIN t d ON d.id = l.b AND d.label = c.label),
n AS (SELECT links, count(*) AS n_links FROM l GROUP BY 1), g AS (SELECT links, count(*) AS n_right FROM r GROUP BY 1)
SELECT s.links, coalesce(n_links, 0) AS n_links, coalesce(n_right, 0) AS n_right, round(n_right::DOUBLE / n_links, 9) AS precision FROM (VALUES ('time'), ('any'), ('stable')) s(links) LEFT JOIN n USING (links) LEFT JOIN g USING (links)"""
SQL["recent_history"] = """
SELECT a.event_id::VARCHAR AS record_id, count(b.event_id) AS history_size, arg_max(b.event_id, (b.ts, b.event_id))::VARCHAR AS last_id, arg_min(b.event_id, (b.ts, b.event_id))::VARCHAR AS first_id
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) AND epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000 GROUP BY a.event_id"""
