"""The registered queries as SQL.

Ids are SHA-256 of joined parts, windows are clock-aligned, arrays are joined to text. Where a
query's rows need the same base, that is a snippet here.
"""

from __future__ import annotations

from logweave.operators.frames import ACTION_RULES, KEYWORD_ACTIONS, KEYWORD_OUTCOMES, OUTCOMES
from logweave.operators.graph import EDGE_OF_ROLE

SQL: dict[str, str] = {}


def _ladder(text: str, steps: tuple, otherwise: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'''contains({text}, '{w}')''' for w in words)} THEN '{value}'" for words, value in steps)
    return f"CASE {whens} ELSE '{otherwise}' END"


def _of(key: str, pairs: dict[str, str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{otherwise}' END"


# documents as raw records
RAW = """raw AS (
  SELECT doc_id, source AS source_file, doc_id AS source_line, CASE WHEN length(text) >= 40 THEN text END AS payload,
    CASE WHEN doc_id % 7 <> 0 THEN '2026-01-01T00:00:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' END AS time,
    sha256('documents|' || source || '|' || doc_id) AS record_id
  FROM documents),
parsed AS (
  SELECT *, coalesce(payload, '') AS template, CASE WHEN time IS NULL THEN 'missing_timestamp' WHEN NOT regexp_matches(coalesce(payload, ''), '\\S') THEN 'empty_payload' END AS reason FROM raw)"""

SQL["record_ids"] = "SELECT event_id, sha256('events|' || event_type || '|' || event_id) AS record_id, sha256(props) AS source_hash FROM events"
SQL["text_source_roundtrip"] = r"""
WITH lines AS (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT sha256(line) AS line_sha256, count(*) AS records, count(*) AS record_ids FROM lines WHERE regexp_matches(line, '\S') GROUP BY 1"""
SQL["text_source_all_lines"] = """
WITH c AS (SELECT turn, len(string_split(replace(text, chr(13), ' '), chr(10))) AS n FROM conversations WHERE text IS NOT NULL)
SELECT '' AS time, sum(n - (turn % 2 = 0)::INT)::BIGINT AS lines FROM c
UNION ALL SELECT '2026-02-03T04:05:0' || turn % 10 || '.25', count(*) FROM c WHERE turn % 2 = 0 GROUP BY 1 UNION ALL SELECT 'gaps', 0"""
SQL["parse_documents"] = f"""
WITH {RAW}
SELECT record_id, source_line, 'text' AS format, substr(sha256(template), 1, 16) AS template_id, reason IS NOT NULL AS quarantined, reason AS quarantine_reason, CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS parse_confidence
FROM parsed"""
SQL["quarantine_split"] = f"""
WITH {RAW}
SELECT source_file, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
  count(*) FILTER (WHERE reason = 'missing_timestamp') AS missing_timestamp, count(*) FILTER (WHERE reason = 'empty_payload') AS empty_payload
FROM parsed GROUP BY source_file"""
SQL["dedup_hash"] = f"""
WITH {RAW}
SELECT source_file, source_line, h AS source_hash, copies FROM (
  SELECT source_file, source_line, sha256(template) AS h, count(*) OVER (PARTITION BY source_file, template) AS copies, row_number() OVER (PARTITION BY source_file, template ORDER BY source_line) AS n FROM parsed)
WHERE n = 1"""
SQL["duplicate_counts"] = f"WITH {RAW} SELECT source_file, count(*) AS rows, count(*) - count(DISTINCT template) AS duplicates FROM parsed GROUP BY source_file"

SQL["hard_negatives"] = "SELECT doc_id FROM labels WHERE quality = 0 ORDER BY sha256('7|' || doc_id), doc_id LIMIT 100"

# Masking without look-around: text in pieces of digits and others, of which the digits look at their neighbours
MASKED = r"""ips AS (
  SELECT doc_id, text AS original, regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^A-Za-z0-9])(?:\d{1,3}\.){3}\d{1,3}($|[^A-Za-z0-9])', '\1<IP>\2', 'g'), '(^|[^A-Za-z0-9])(?:\d{1,3}\.){3}\d{1,3}($|[^A-Za-z0-9])', '\1<IP>\2', 'g') AS t FROM documents),
ids AS (SELECT doc_id, original, regexp_replace(regexp_replace(t, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<UUID>', 'g'), '(?i)\b0x[0-9a-f]{6,}\b', '<HEX>', 'g') AS t FROM ips),
pieces AS (SELECT doc_id, original, regexp_extract_all(t, '\d+|\D+') AS p FROM ids),
sides AS (
  SELECT doc_id, original, list_transform(range(1, len(p) + 1), lambda i: CASE
    WHEN NOT regexp_matches(p[i], '^\d') OR (i > 1 AND regexp_matches(lower(p[i - 1]), '(eventid|status|result|action)=$')) THEN p[i]
    WHEN len(p[i]) - (CASE WHEN i > 1 AND regexp_matches(p[i - 1], '[A-Za-z_]$') THEN 1 ELSE 0 END) - (CASE WHEN i < len(p) AND regexp_matches(p[i + 1], '^[A-Za-z_]') THEN 1 ELSE 0 END) < 1 THEN p[i]
    ELSE (CASE WHEN i > 1 AND regexp_matches(p[i - 1], '[A-Za-z_]$') THEN p[i][1] ELSE '' END) || '<NUM>' || (CASE WHEN i < len(p) AND regexp_matches(p[i + 1], '^[A-Za-z_]') THEN p[i][-1] ELSE '' END) END) AS q
  FROM pieces),
masked AS (SELECT doc_id, original, array_to_string(q, '') AS template FROM sides),
printed AS (SELECT *, sha256(lower(trim(regexp_replace(template, '\s+', ' ', 'g')))) AS fingerprint FROM masked)"""
SQL["mask_templates"] = f"WITH {MASKED} SELECT doc_id, sha256(template) AS masked_sha256, fingerprint FROM printed"
SQL["template_catalog"] = f"WITH {MASKED} SELECT fingerprint, count(*) AS size, length(min(template)) AS chars FROM printed GROUP BY fingerprint"
SQL["template_metrics"] = f"""
WITH {MASKED},
g AS (SELECT original AS t, count(*) AS n FROM printed GROUP BY 1),
p AS (SELECT template AS t, count(*) AS n FROM printed GROUP BY 1),
b AS (SELECT coalesce(sum(least(g.n, p.n)), 0) AS common FROM g JOIN p USING (t))
SELECT count(*) AS rows, avg((original = template)::INT) AS grouping_accuracy, 2 * any_value(common)::DOUBLE / (count(original) + count(template)) AS template_f1 FROM printed, b"""

_action = lambda k: _ladder("low", tuple((rule[0], rule[k]) for rule in ACTION_RULES), "unknown")
SQL["event_frames_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
s AS (
  SELECT *, {_action(1)} AS action_family, {_action(2)} AS action_leaf, {_action(3)} AS relation_type,
    rtrim(regexp_extract(text, '(?i)(?:user|account|principal)\s+([A-Za-z][\p{{L}}\p{{N}}_.-]*)', 1), '.,;)') AS actor,
    rtrim(regexp_extract(text, '(?i)host[- ]?([A-Za-z0-9_.-]+)', 1), '.,;)') AS destination_host,
    rtrim(regexp_extract(text, '(?i)(?:process|started)\s+([\p{{L}}\p{{N}}_.-]+\.exe)', 1), '.,;)') AS process,
    rtrim(regexp_extract(text, '((?:[A-Za-z]:\\|/)[^\s,;]+)', 1), '.,;)') AS object,
    regexp_extract(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') AS destination_ip
  FROM d)
SELECT doc_id, action_family, action_leaf, relation_type, {_ladder("low", OUTCOMES, "unknown")} AS outcome, CASE WHEN action_leaf = 'unknown' THEN 0.35 ELSE 0.9 END::DOUBLE AS semantic_confidence,
  actor, destination_host, process, object, destination_ip, ((actor <> '')::INT + (destination_host <> '')::INT + (process <> '')::INT + (object <> '')::INT + (destination_ip <> '')::INT)::BIGINT AS n_mentions
FROM s"""

_MENTIONS = r"list_concat(list_concat(regexp_extract_all({0}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b'), regexp_extract_all({0}, '(?:[A-Za-z]:\\|/)[^\s,;]+')), regexp_extract_all({0}, '(?i)(?:user|account|login|uid)[=: ]+([A-Za-z0-9_.@\\-]+)', 1))"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_ACTOR = r"coalesce(list_filter({0}, lambda x: contains(x, '\') OR contains(x, '@'))[1], 'unknown')"
_OBJECT = r"coalesce(list_filter({0}, lambda x: regexp_matches(x, '^(?:/|[A-Za-z]:\\)'))[1], 'unknown')"
SQL["keyword_frames"] = f"""
WITH c AS (SELECT conv_id, turn, lower(text) AS low, {_MENTIONS.format("text")} AS m FROM conversations)
SELECT conv_id, turn, {_ladder("low", KEYWORD_ACTIONS, "unknown")} AS action, {_ladder("low", KEYWORD_OUTCOMES, "unknown")} AS outcome, {_ACTOR.format("m")} AS actor, {_OBJECT.format("m")} AS object,
  CASE WHEN {_ladder("low", KEYWORD_ACTIONS, "unknown")} = 'unknown' THEN 0.75 ELSE 1.0 END::DOUBLE AS semantic_confidence
FROM c"""
SQL["mention_extract"] = f"""
WITH m AS (SELECT doc_id, {_MENTIONS.format("text")} AS a FROM documents), d AS (SELECT doc_id, {_DISTINCT.format("a")} AS e FROM m)
SELECT doc_id, len(e)::BIGINT AS n, array_to_string(e, chr(10)) AS mentions, {_ACTOR.format("e")} AS actor, {_OBJECT.format("e")} AS object FROM d"""
SQL["taxonomy_enrichment"] = """
SELECT c_custkey, r_name AS region, n_name AS nation, c_mktsegment AS segment, (CASE WHEN n_name IS NULL THEN 1 ELSE 3 END)::BIGINT AS n_attributes
FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey"""
SQL["defaulted_frames"] = """
SELECT event_id::VARCHAR AS record_id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS action_family, 'unknown' AS outcome, 1.0::DOUBLE AS unknown_score, 'mock' AS semantic_version FROM events"""

# events as frames, mentions and simple entities
FRAMES = """f AS (
  SELECT event_id::VARCHAR AS record_id, event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, user_id::VARCHAR AS actor, json_extract_string(props, '$.k') AS k, event_type,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'unknown' END AS outcome, value
  FROM events),
m AS (
  SELECT record_id, timestamp, 0 AS position, actor AS raw_value, 'actor' AS role, 'user' AS entity_type, lower(actor) AS canonical_value FROM f
  UNION ALL SELECT record_id, timestamp, 1, k, 'object', 'file', replace(k, chr(92), '/') FROM f WHERE k IS NOT NULL),
e AS (SELECT *, sha256('events|' || entity_type || '|' || canonical_value || '|') AS entity_id FROM m),
simple AS (SELECT record_id, event_id, timestamp, v AS value, 'token:' || substr(sha256('token|' || lower(v)), 1, 24) AS entity_id FROM (SELECT *, unnest([actor, k]) AS v FROM f) WHERE v IS NOT NULL)"""
SQL["entity_links"] = f"WITH {FRAMES} SELECT record_id AS event_id, role, entity_type, canonical_value, entity_id, 0.9::DOUBLE AS confidence FROM e"
SQL["entity_table"] = f"WITH {FRAMES} SELECT entity_id, min(entity_type) AS entity_type, min(canonical_value) AS canonical_value, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS mentions FROM e GROUP BY entity_id"
SQL["simple_entities"] = rf"""
WITH a AS (SELECT doc_id, {_MENTIONS.format("text")} AS a FROM documents), v AS (SELECT doc_id, unnest({_DISTINCT.format("a")}) AS v FROM a),
t AS (SELECT *, CASE WHEN regexp_full_match(v, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}') THEN 'ip' WHEN regexp_matches(v, '^(?:/|[A-Za-z]:\\)') THEN 'path' WHEN contains(v, '@') OR contains(v, '\') THEN 'account' ELSE 'token' END AS entity_type FROM v),
c AS (SELECT *, CASE WHEN entity_type = 'ip' THEN trim(v) ELSE lower(rtrim(replace(trim(v), '\', '/'), '/')) END AS canonical_value FROM t)
SELECT doc_id, entity_type, canonical_value, entity_type || ':' || substr(sha256(entity_type || '|' || canonical_value), 1, 24) AS entity_id FROM c"""
SQL["alias_lookup"] = f"""
WITH {FRAMES}, n AS (SELECT record_id, coalesce(lower(trim(c_name)), actor) AS canonical_value FROM f LEFT JOIN customer ON c_custkey::VARCHAR = actor)
SELECT record_id, canonical_value, 'token:' || substr(sha256('token|' || canonical_value), 1, 24) AS entity_id FROM n"""
SQL["event_summary"] = f"WITH {FRAMES} SELECT record_id AS event_id, count(*) AS entity_count, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entity_types FROM e GROUP BY record_id"
SQL["entity_latest"] = """SELECT user_id::VARCHAR AS entity_id, max(event_id) AS "order", arg_max(event_type, event_id) AS action_family FROM events GROUP BY user_id"""
SQL["entity_matches"] = f"WITH {FRAMES} SELECT entity_type, entity_id, count(*) AS mentions, count(DISTINCT record_id) AS events FROM e WHERE entity_type <> 'ip' GROUP BY ALL HAVING count(DISTINCT record_id) > 1"
SQL["entity_pair_scores"] = f"""
WITH {FRAMES},
all_of AS (
  SELECT record_id, 'actor' AS role, 'user' AS entity_type, lower(actor) AS v FROM f UNION ALL SELECT record_id, 'object', 'file', replace(k, chr(92), '/') FROM f WHERE k IS NOT NULL AND event_id % 3 = 1
  UNION ALL SELECT record_id, 'destination_ip', 'ip', '10.0.0.' || event_id % 5 FROM f WHERE event_id % 3 = 2),
p AS (
  SELECT record_id AS event_id, role, entity_type, v, lag(entity_type) OVER w AS t, lag(v) OVER w AS u FROM all_of
  WINDOW w AS (PARTITION BY record_id::BIGINT // 100 ORDER BY role <> 'actor', entity_type, record_id::BIGINT)),
r AS (SELECT *, CASE WHEN t <> entity_type THEN 'scope_mismatch' WHEN t = 'ip' THEN 'weak_ip_only' WHEN u = v THEN 'canonical_and_scope_match' ELSE 'no_match' END AS reason FROM p WHERE t IS NOT NULL)
SELECT event_id, role, reason, (reason = 'canonical_and_scope_match')::INT::DOUBLE AS score FROM r"""

_ACTION = "'action:' || substr(sha256(event_type), 1, 24)"
SQL["event_graph_edges"] = f"""
WITH {FRAMES}, u AS (
  SELECT entity_id AS source, 'event:' || record_id AS target, 'participates' AS relation, timestamp, event_id FROM simple
  UNION ALL SELECT 'event:' || record_id, {_ACTION}, 'has_action', timestamp, event_id FROM f)
SELECT source, target, relation, count(*)::DOUBLE AS weight, arg_max(timestamp, event_id) AS timestamp FROM u GROUP BY source, target, relation"""
SQL["event_graph_nodes"] = f"""
WITH {FRAMES}, n AS (
  SELECT 'event:' || record_id AS id, 'event' AS node_type, event_type AS value FROM f UNION ALL SELECT DISTINCT entity_id, 'token', lower(value) FROM simple UNION ALL SELECT DISTINCT {_ACTION}, 'action', event_type FROM f)
SELECT id AS node_id, node_type, value, CASE WHEN node_type <> 'event' THEN '' WHEN value = 'error' THEN 'failure' ELSE 'unknown' END AS outcome FROM n"""
SQL["graph_bounds"] = f"""
WITH {FRAMES} SELECT 'window:' || substr(sha256(strftime(min(ts), '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16) AS window_id, min(timestamp) AS start_time, max(timestamp) AS end_time FROM f"""
SQL["graph_summary"] = f"""
WITH {FRAMES}, n AS (SELECT (SELECT count(*) FROM f) + (SELECT count(DISTINCT entity_id) FROM e) AS nodes)
SELECT any_value(nodes)::BIGINT AS node_count, count(*) AS edge_count, string_agg(DISTINCT {_of("role", EDGE_OF_ROLE, "session_of")}, ',' ORDER BY {_of("role", EDGE_OF_ROLE, "session_of")}) AS relations, count(*)::DOUBLE / any_value(nodes) AS score FROM e, n"""
SQL["per_event_graphs"] = f"""
WITH {FRAMES} SELECT record_id, concat_ws(',', 'event/event:' || record_id, 'unknown/' || actor, 'unknown/' || k) AS nodes, concat_ws(',', 'actor_of/' || actor || '/event:' || record_id, 'actor_of/' || k || '/event:' || record_id) AS edges FROM f"""
_TENSORS = f"""{FRAMES}, n AS (SELECT 'event:' || record_id AS id, 'event' AS t FROM f UNION ALL SELECT DISTINCT entity_id, 'unknown' FROM e),
i AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS nth FROM n)"""
SQL["graph_tensors"] = f"""
WITH {_TENSORS} SELECT s.nth AS source_index, t.nth AS target_index, (dense_rank() OVER (ORDER BY {_of("role", EDGE_OF_ROLE, "session_of")}) - 1)::INT AS relation_id FROM e JOIN i s ON s.id = e.entity_id JOIN i t ON t.id = 'event:' || record_id"""
SQL["graph_tensor_nodes"] = f"""
WITH {_TENSORS} SELECT nth AS node_index, id AS node_id, (('0x' || substr(sha256(t), 1, 8))::BIGINT % 32)::INT AS type_id, ascii(t || '|' || id)::BIGINT AS first_byte, ascii(substr(t || '|' || id, 8, 1))::BIGINT AS last_byte FROM i"""
SQL["neighbor_mean"] = """
WITH m AS (SELECT l_suppkey AS node, avg(embedding[1]::DOUBLE) AS m0, avg(embedding[2]::DOUBLE) AS m1, avg(list_sum(embedding::DOUBLE[])) AS s FROM lineitem JOIN embeddings ON vec_id = l_partkey GROUP BY 1)
SELECT vec_id AS node_id, round(coalesce(m0, 0), 5) AS m0, round(coalesce(m1, 0), 5) AS m1, round(coalesce(s, 0), 4) AS total FROM embeddings LEFT JOIN m ON node = vec_id"""
SQL["byte_vectors"] = f"""
WITH {FRAMES}, t AS (SELECT record_id, substr(CASE WHEN k IS NULL THEN 'actor=' || actor ELSE 'actor=' || actor || '|object=' || k END, 1, 12) AS t FROM f)
SELECT record_id, list_sum(list_transform(string_split(t, ''), lambda c: ascii(c)))::BIGINT AS total, ascii(t)::BIGINT AS first FROM t"""

SQL["causal_history"] = """
WITH h AS (SELECT event_id, count(*) OVER all_before AS n, first_value(event_id) OVER w AS a, last_value(event_id) OVER w AS z FROM events
  WINDOW all_before AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))
SELECT event_id::VARCHAR AS record_id, n AS history_size, least(n, 16) AS kept, z::VARCHAR AS last_id, a::VARCHAR AS first_id FROM h"""
SQL["history_leaks"] = "SELECT event_id::VARCHAR AS record_id, CASE WHEN event_id % 100 = 0 THEN 'history' ELSE 'graph_edge' END AS reason FROM events WHERE event_id % 100 = 0 OR event_id % 250 = 1"
SQL["links_before"] = f"""
WITH {FRAMES}, c AS (SELECT timestamp AS t, event_id AS i FROM f WHERE event_id = 500), b AS (SELECT f.record_id FROM f, c WHERE (f.timestamp, f.event_id) < (t, i))
SELECT (SELECT count(*) FROM b) AS earlier, (SELECT count(*) FROM e WHERE record_id IN (SELECT record_id FROM b)) AS earlier_links, (SELECT count(*) FROM f WHERE event_id <> 500) AS others"""


def _start(minutes: int) -> str:
    return f"(date_trunc('hour', ts) + to_minutes((minute(ts) // {minutes} * {minutes})::BIGINT))"


def _window(minutes: int, start: str = "start") -> str:
    return f"'window:' || substr(sha256('events|{minutes}|' || strftime({start}, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16)"


for _name, _minutes in (("micro_windows", 5), ("macro_windows", 30)):
    SQL[_name] = f"""
WITH w AS (SELECT *, {_start(_minutes)} AS start FROM events)
SELECT {_window(_minutes)} AS window_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(start + to_minutes({_minutes}), '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS event_count,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions, round(avg(1 / (1 + exp(-value))), 6) AS suspicious_score
FROM w GROUP BY start"""
SQL["window_vectors"] = f"""
WITH w AS (SELECT {_start(30)} AS start, embedding FROM events JOIN embeddings ON vec_id = event_id),
x AS (SELECT start, unnest(range(0, 70)) AS position, embedding FROM w)
SELECT {_window(30)} AS window_id, position::INT AS position, round(avg(coalesce(embedding[position + 1]::DOUBLE, 0)), 5) AS x FROM x GROUP BY start, position"""

# error windows by user, and their links within a day
def _links(where: str, gap: int) -> str:
    return f"""u AS (SELECT DISTINCT {_window(5)} AS id, start, value FROM (SELECT {_start(5)} AS start, user_id::VARCHAR AS value FROM events WHERE {where})),
l AS (
  SELECT a.id AS source_window, b.id AS target_window, list(DISTINCT a.value ORDER BY a.value) AS anchors, any_value(epoch(b.start) - epoch(a.start)) AS delta
  FROM u a JOIN u b ON a.value = b.value AND (a.start, a.id) < (b.start, b.id) AND epoch(b.start) - epoch(a.start) <= {gap} GROUP BY a.id, b.id)"""


LINKS, ALL = _links("event_type = 'error'", 86400), _links("TRUE", 3600)
SQL["window_links"] = f"WITH {LINKS} SELECT source_window, target_window, array_to_string(anchors, ',') AS anchors, 'strong' AS anchor_strength, delta::BIGINT AS delta_seconds FROM l"
SQL["stream_live_links"] = f"WITH {ALL} SELECT source_window, target_window FROM l"
SQL["ip_only_rejections"] = f"""
WITH x AS (SELECT {_start(5)} AS start, user_id::VARCHAR AS actor, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error'),
r AS (SELECT DISTINCT {_window(5)} AS id, start, value, strong FROM (SELECT start, actor AS value, TRUE AS strong FROM x UNION ALL SELECT start, k, FALSE FROM x WHERE k IS NOT NULL)),
p AS (SELECT a.id AS source_window, b.id AS target_window, a.value, a.strong FROM r a JOIN r b ON a.value = b.value AND a.strong = b.strong AND (a.start, a.id) < (b.start, b.id) AND epoch(b.start) - epoch(a.start) <= 3600)
SELECT source_window, target_window, coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE strong), '') AS shared_strong, coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE NOT strong), '') AS shared_ip,
  bool_or(strong) AS candidate, CASE WHEN bool_or(strong) THEN '' ELSE 'ip_only_anchor' END AS rejected_reason
FROM p GROUP BY source_window, target_window"""
QUEUES = f"""{LINKS},
b AS (SELECT source_window AS a, target_window AS z FROM l UNION SELECT target_window, source_window FROM l),
reach AS (SELECT a, a AS z FROM b UNION SELECT r.a, b.z FROM reach r JOIN b ON b.a = r.z),
members AS (SELECT a AS id, min(z) AS root FROM reach GROUP BY a),
named AS (SELECT id, root, 'attack_queue_' || lpad((dense_rank() OVER (ORDER BY root) - 1)::VARCHAR, 4, '0') AS queue_id FROM members)"""
SQL["attack_queues"] = f"WITH RECURSIVE {QUEUES} SELECT queue_id, count(*) AS windows, min(id) AS first_window, max(id) AS last_window FROM named GROUP BY queue_id"
SQL["campaign_queues"] = f"""
WITH RECURSIVE {QUEUES}
SELECT queue_id, count(DISTINCT u.id) AS windows, count(DISTINCT u.value) AS users, strftime(min(start), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(max(start), '%Y-%m-%d %H:%M:%S') AS last_start
FROM named n JOIN u ON u.id = n.id GROUP BY queue_id"""
SQL["link_evidence"] = f"""
WITH {ALL},
w AS (
  SELECT {_window(5)} AS id, list(DISTINCT json_extract_string(props, '$.k')) AS path, list(DISTINCT event_type) AS acts, [count(*)::DOUBLE, sum(value)] AS g
  FROM (SELECT *, {_start(5)} AS start FROM events) GROUP BY start),
n AS (SELECT count(DISTINCT id) AS n FROM u), r AS (SELECT value, ln(any_value(n)::DOUBLE / count(DISTINCT id)) AS rarity FROM u, n GROUP BY value),
s AS (SELECT source_window, target_window, avg(rarity) AS stable_rarity FROM (SELECT source_window, target_window, unnest(anchors) AS value FROM l) JOIN r USING (value) GROUP BY 1, 2),
x AS (
  SELECT l.source_window, l.target_window, len(anchors)::DOUBLE AS anchor_score, stable_rarity, list_has_any(a.acts, b.acts)::INT::DOUBLE AS action_compatibility, len(list_intersect(a.path, b.path))::DOUBLE / len(list_distinct(list_concat(a.path, b.path))) AS path_coherence,
    list_dot_product(a.g, b.g) / (sqrt(list_dot_product(a.g, a.g)) * sqrt(list_dot_product(b.g, b.g))) AS graph_cosine, delta
  FROM l JOIN w a ON a.id = l.source_window JOIN w b ON b.id = l.target_window JOIN s USING (source_window, target_window))
SELECT source_window, target_window, anchor_score, round(stable_rarity, 6) AS stable_rarity, action_compatibility, round(path_coherence, 6) AS path_coherence, round(graph_cosine, 6) AS graph_cosine,
  round(1 / (1 + exp(-(-1.0 + anchor_score + 0.5 * (action_compatibility + path_coherence + graph_cosine) + exp(-delta / 3600.0 / 6)))), 6) AS score
FROM x"""
SQL["entity_memory"] = f"WITH {ALL} SELECT 'user' AS entity_type, value, count(*) AS n, string_agg(id, ',' ORDER BY start, id) AS windows FROM u GROUP BY value"
SQL["entity_rarity"] = f"WITH {ALL}, n AS (SELECT count(DISTINCT id) AS n FROM u) SELECT value, round(ln(any_value(n)::DOUBLE / count(DISTINCT id)), 9) AS rarity FROM u, n GROUP BY value"
SQL["suspicious_values"] = f"WITH {ALL} SELECT DISTINCT value FROM u"
SQL["pair_evidence"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS b, lag(embedding::DOUBLE[]) OVER w AS a, lag(vec_id) OVER w AS before_id FROM embeddings WINDOW w AS (PARTITION BY label, vec_id // 1000 ORDER BY vec_id)),
p AS (SELECT *, greatest((vec_id - before_id) * 600, 0) / 3600.0 AS h FROM e WHERE a IS NOT NULL)
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, (4 * len(a) + 4)::BIGINT AS n,
  round(list_sum(a) + list_sum(b) + list_dot_product(a, b) + list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) + exp(-h) + exp(-h / 6) + exp(-h / 24) + 1, 4) AS total
FROM p"""

SQL["feature_join"] = f"""
WITH x AS (SELECT *, {_start(5)} AS s5, {_start(30)} AS s30, 1 / (1 + exp(-value)) AS p FROM events),
y AS (SELECT event_id::VARCHAR AS record_id, value, avg(p) OVER (PARTITION BY s5) AS micro, avg(p) OVER (PARTITION BY s30) AS macro FROM x)
SELECT record_id, round(ln(1 + value), 6) AS raw_event_score, round(micro, 6) AS micro_window_score, round(macro, 6) AS macro_window_score, round(greatest(micro, macro), 6) AS long_horizon_score, 0.25::DOUBLE AS slot_nll, round(value, 6) AS graph_first FROM y"""
SQL["feature_gaps"] = """
SELECT doc_id AS record_id, 'label' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'embedding' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
SQL["source_split"] = """
WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, CASE WHEN source = 'src3' THEN 'test' WHEN nth <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.8)) ELSE n END THEN 'train' ELSE 'validation' END AS split FROM o"""
SQL["half_split"] = """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= greatest(1, (SELECT count(*) FROM orders) // 2) THEN 'train' ELSE 'validation' END AS split FROM orders"""
SQL["leakage_audit"] = """
WITH r AS (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 10 = 0)
SELECT 'duplicate_record_id' AS finding, doc_id::VARCHAR AS record_id, count(*) - 1 AS occurrences FROM r GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'target_access', doc_id::VARCHAR, count(*) FROM r WHERE contains(lower(source), 'src1') GROUP BY doc_id
UNION ALL SELECT 'test_label_training', doc_id::VARCHAR, count(*) FROM r WHERE doc_id % 4 = 0 AND doc_id % 9 <> 0 GROUP BY doc_id"""

SCORED = "s AS (SELECT doc_id, source, quality AS label, toxic, (n_chars % 1000) / 500.0::DOUBLE - 1 AS x FROM labels JOIN documents USING (doc_id))"
SQL["threshold_fit"] = f"WITH {SCORED} SELECT round(coalesce(min(x * 2 - 0.1) FILTER (WHERE label <> 0), 1.0), 9) AS threshold FROM s"
SQL["calibration_fit"] = f"WITH {SCORED} SELECT source, 1.0::DOUBLE AS temperature, round(coalesce(quantile_cont(1 / (1 + exp(-(x * 2 - 0.1))), 0.995) FILTER (WHERE label = 0), 0.5), 9) AS threshold FROM s GROUP BY source"
SQL["score_eval"] = """
SELECT count(*) AS records_scored, avg(((n_chars % 3 <> 0) = (quality <> 0))::INT) AS accuracy_at_0_5, sum(quality)::BIGINT AS positive_labels FROM documents JOIN labels USING (doc_id) HAVING count(*) > 0"""
_BCE = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))) - {0} * label)"
_FOCAL = "round(avg(pow(greatest(1 - (label / (1 + exp(-({0}))) + (1 - label) * (1 - 1 / (1 + exp(-({0}))))), 1e-6), 2) * " + _BCE + "), 6)"
SQL["loss_metrics"] = f"""
WITH {SCORED} SELECT {_FOCAL.format("(x)")} AS event, {_FOCAL.format("(x * 0.5)")} AS micro, {_FOCAL.format("(x + 0.25)")} AS macro, {_FOCAL.format("(x * 2 - 0.1)")} AS fused,
  round(avg({_BCE.format("(x * 2 - 0.1)")}), 6) AS bce, round(avg(abs(1 / (1 + exp(-x)) - 1 / (1 + exp(-x * 0.5)))), 6) AS hierarchy FROM s"""
SQL["ranking_loss"] = f"""
WITH {SCORED}, p AS (SELECT a.source, avg(ln(1 + exp(1 - (a.x * 2 - 0.1) + (b.x * 2 - 0.1)))) AS r FROM s a JOIN s b ON a.source = b.source AND a.label <> 0 AND b.label = 0 GROUP BY a.source)
SELECT DISTINCT s.source AS batch, round(coalesce(r, 0), 6) AS ranking FROM s LEFT JOIN p USING (source)"""
SQL["vector_losses"] = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) AS nxt FROM embeddings),
a AS (SELECT avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1]) AS nll FROM e WHERE vec_id % 10 <> 0),
b AS (SELECT (avg(greatest(0, 1 - v[1] + v[2])) + avg(greatest(0, 1 - v[3] + v[4]))) / 2 AS m FROM e),
c AS (SELECT 1 - avg(list_dot_product(v, nxt) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nxt, nxt)))) AS c FROM e WHERE nxt IS NOT NULL)
SELECT round(nll, 5) AS slot_nll, round(m, 5) AS margin, round(c, 5) AS contrast FROM a, b, c"""
SQL["mean_metrics"] = "SELECT o_orderpriority AS run, o_orderstatus AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2"
SQL["alert_curve"] = f"""
WITH {SCORED}, o AS (SELECT toxic, row_number() OVER (ORDER BY (x * 2 - 0.1) * 1000 + doc_id / 1e7 DESC) AS nth, sum(toxic) OVER () AS p FROM s)
SELECT b AS budget, round(coalesce(sum(toxic) FILTER (WHERE nth <= b)::DOUBLE / nullif(any_value(p), 0), 0), 9) AS recall FROM o, (SELECT unnest([10, 100, 1000])::INT AS b) GROUP BY b"""

SQL["state_audit"] = """
WITH m AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, user_id, previous, event_type AS state FROM m
WHERE previous IS NOT NULL AND (previous, event_type) NOT IN (('view', 'click'), ('click', 'signup'), ('signup', 'purchase'), ('purchase', 'view'), ('view', 'view'))"""
SQL["tamper_check"] = """
SELECT '/doc/' || doc_id AS path, CASE WHEN doc_id % 97 = 0 THEN 'not_sealed' WHEN doc_id % 50 = 3 THEN 'missing' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 97 = 0 OR doc_id % 50 IN (3, 7)"""
SQL["registry_audit"] = """
SELECT c_custkey::VARCHAR AS dataset_id, 'missing fields display_name' AS violation FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'invalid status lost' FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'target label usage must be evaluation_only_p1' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 <> 0"""
SQL["sink_roundtrip"] = "SELECT doc_id, source, sha256(text) AS text_sha256, n_chars FROM documents"
SQL["stream_windows"] = "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS event_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions FROM events GROUP BY time_bucket(INTERVAL 30 MINUTE, ts)"
SQL["stream_dedup"] = "SELECT event_id, event_type FROM events"
SQL["stream_templates"] = r"""SELECT event_type || ' ' || regexp_replace(props, '\d+', '<NUM>', 'g') AS template, count(*) AS size FROM events GROUP BY 1"""
