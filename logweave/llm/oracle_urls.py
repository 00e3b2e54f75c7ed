"""The URL filter as SQL: rules, both character models, the threshold and the verdicts."""

from __future__ import annotations

from logweave.llm.url_filter import BUCKET, MAX_FIT, MIN_CONTEXT, ORDER, RADIX, RULES, SYMBOLS, UNIT

_BEST = sorted(RULES, key=lambda r: -len(r[1]))
_fits = lambda rule: "('.' || host LIKE '%.{}' AND starts_with(path, '/{}'))".format(*rule.split("/", 1))
_case = lambda values: "CASE " + " ".join(f"WHEN {_fits(rule)} THEN '{value}'" for value, rule in values) + " END"


def _level(k: int) -> str:
    """P(symbol | k symbols before) in both models, as mixed with level k - 1."""
    mixed = lambda n, t, d, p: f"CASE WHEN {t} > 0 THEN (coalesce({n}, 0) + {d} * {p}) / ({t} + {d}) ELSE {p} END"
    return f"""
seen{k} AS (SELECT code % {RADIX ** (k + 1)} AS code, sum(na)::BIGINT AS na, sum(nb)::BIGINT AS nb FROM counts GROUP BY 1),
contexts{k} AS (
  SELECT code // {RADIX} AS context, sum(na)::BIGINT AS ta, sum(nb)::BIGINT AS tb, count(*) FILTER (WHERE na > 0) AS da, count(*) FILTER (WHERE nb > 0) AS db
  FROM seen{k} GROUP BY 1 HAVING sum(na) + sum(nb) >= {MIN_CONTEXT}),
level{k} AS (
  SELECT c.code, {mixed("s.na", "x.ta", "x.da", "b.pa")} AS pa, {mixed("s.nb", "x.tb", "x.db", "b.pb")} AS pb
  FROM (SELECT unnest(range({RADIX ** (k + 1)})) AS code) c JOIN level{k - 1} b ON b.code = c.code % {RADIX**k}
  LEFT JOIN seen{k} s ON s.code = c.code LEFT JOIN contexts{k} x ON x.context = c.code // {RADIX}),"""


OP13 = rf"""
WITH split AS (
  SELECT page_id, row_number() OVER () AS row, coalesce(url, '') AS text, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (SELECT *, {_case([(rule, rule) for _, rule in _BEST])} AS rule, {_case(_BEST)} AS ruled FROM split),
plain AS (
  SELECT *, regexp_replace(translate(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '_', '-'), '(?s)[^a-z0/.\-]', '~', 'g') AS s FROM ruled),
symbols AS (
  SELECT row, i, CASE WHEN i > length(s) THEN 0 ELSE instr('{SYMBOLS}', substr(s, i::INT, 1)) END AS symbol FROM (SELECT row, s, unnest(range(1, length(s) + 2)) AS i FROM plain)),
windows AS (
  SELECT row, {" + ".join(f"{RADIX**k} * coalesce(lag(symbol, {k}) OVER w, 0)" for k in range(ORDER))} AS code FROM symbols WINDOW w AS (PARTITION BY row ORDER BY i)),
labelled AS (SELECT row, ruled = 'allow' AS allow, md5(url) AS hash FROM ruled WHERE ruled IS NOT NULL),
sample AS (
  SELECT row, allow, hash[32] IN ('0', '1', '2', '3') AS held FROM labelled QUALIFY row_number() OVER (PARTITION BY allow ORDER BY hash) <= {MAX_FIT}),
counts AS (
  SELECT code, count(*) FILTER (WHERE allow) AS na, count(*) FILTER (WHERE NOT allow) AS nb FROM windows JOIN sample USING (row) WHERE NOT held GROUP BY code),
"level-1" AS (SELECT 0 AS code, {1.0 / RADIX}::DOUBLE AS pa, {1.0 / RADIX}::DOUBLE AS pb),{"".join(map(_level, range(ORDER))).replace("level-1 b", '"level-1" b')}
ratios AS (SELECT code, floor((ln(pa) - ln(pb)) * {UNIT} + 0.5)::INT AS score FROM level{ORDER - 1}),
scored AS (SELECT row, floor(sum(score)::DOUBLE / count(*))::BIGINT AS score FROM windows JOIN ratios USING (code) GROUP BY row),
held AS (SELECT allow, floor(score / {BUCKET})::BIGINT AS bucket FROM scored JOIN sample USING (row) WHERE held),
edges AS (SELECT bucket FROM held UNION SELECT 0 UNION SELECT max(bucket) + 1 FROM held),
rated AS (
  SELECT e.bucket, (SELECT count(*) FROM held WHERE allow AND bucket >= e.bucket) * (SELECT count(*) FROM held WHERE NOT allow)
    + (SELECT count(*) FROM held WHERE NOT allow AND bucket < e.bucket) * (SELECT count(*) FROM held WHERE allow) AS hits
  FROM edges e WHERE bucket IS NOT NULL),
threshold AS (SELECT (SELECT bucket FROM rated ORDER BY hits DESC, abs(bucket), bucket LIMIT 1) * {BUCKET} AS least)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict, score, least::BIGINT AS threshold
FROM ruled JOIN scored USING (row), threshold
"""
