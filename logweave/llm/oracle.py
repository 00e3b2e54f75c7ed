"""The registered queries as SQL, where SQL can express them."""

from __future__ import annotations

from logweave.llm.mixing import UNIT
from logweave.llm.quality_rules import BOILERPLATE, SEPARATORS, STOPS, SYMBOLS, Rules
from logweave.llm.sharding import HASH_BITS, QUERY_LIMIT

_R = Rules()
_quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SYMBOLS = r"length(regexp_replace({}, '[^" + SYMBOLS + "]', '', 'g'))"
_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]', '', 'g'))"

OP4 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - {_R.window} + 2)) AS i, words FROM docs WHERE len(words) >= {_R.window}),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(words, i, i + {_R.window} - 1)) AS c FROM starts),
repeats AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + {_R.window})) AS w FROM grams WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
split AS (SELECT doc_id, pos, raw, {_TRIM.format("raw")} AS line, {_WORDS.format("raw")} AS words FROM lines),
listed AS (
  SELECT *, len(words) BETWEEN 1 AND {_R.max_menu_words} AND NOT regexp_matches(line, '[{STOPS}]') AS menu, count(*) OVER (PARTITION BY doc_id, raw) AS copies FROM split),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, menu ORDER BY pos) AS run FROM listed),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, menu, run) AS menu_lines, len(words) AS n, len(list_filter(words, lambda w: w IN ({_quoted(SEPARATORS)}))) AS bars,
    length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper
  FROM runs),
judged AS (
  SELECT *, n > 0 AND (
    (bars >= {_R.min_separators} AND bars > {_R.max_separator_share} * n)
    OR {_SYMBOLS.format("line")} > {_R.max_symbol_share} * length(line)
    OR (n >= 3 AND len(regexp_extract_all(line, '[!?]{{2,}}|!')) > {_R.max_bang_share} * n AND contains(line, '!'))
    OR (letters >= {_R.min_letters} AND upper > {_R.max_upper_share} * letters)
    OR (n <= {_R.max_boilerplate_words} AND ({" OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)}))
    OR (menu AND menu_lines >= {_R.min_menu_lines})
    OR (copies > {_R.max_copies} AND n BETWEEN {_R.min_copied_words} AND {_R.max_boilerplate_words})
    OR (n > {_R.max_words_without_stop} AND NOT regexp_matches(line, '[{STOPS}]'))) AS bad
  FROM counted),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad_lines, coalesce(sum({_CHARS.format("raw")}) FILTER (WHERE bad), 0) AS lost_chars,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT raw) FILTER (WHERE n > 0) AS n_dup_lines
  FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(words) AS n_words, {_CHARS.format("text")} AS word_chars, {_SYMBOLS.format("text")} AS n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_lines, n_bad_lines, lost_chars
  FROM docs d JOIN per USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND lost_chars <= {_R.max_lost_share} * word_chars AS kept,
  n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, lost_chars::BIGINT AS lost_chars
FROM base
"""

OP7 = f"""
WITH docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, {HASH_BITS // 4}))::BIGINT AS bits
  FROM documents),
prefixes AS (SELECT *, unnest(range(0, 25)) AS depth FROM docs),
sums AS (SELECT depth, bits >> ({HASH_BITS} - depth)::INT AS prefix, sum(n_bytes) AS shard_bytes FROM prefixes GROUP BY ALL HAVING sum(n_bytes) <= {QUERY_LIMIT} OR count(*) = 1),
leaves AS (
  SELECT p.doc_id, p.bits, min(p.depth) AS depth FROM prefixes p JOIN sums s ON p.depth = s.depth AND p.bits >> ({HASH_BITS} - p.depth)::INT = s.prefix GROUP BY ALL)
SELECT d.doc_id, d.n_bytes, CASE WHEN l.depth = 0 THEN 'root' ELSE lpad(bin(s.prefix), l.depth::INT, '0') END AS shard, l.depth::BIGINT AS depth, 0::BIGINT AS page, s.shard_bytes::BIGINT AS shard_bytes
FROM docs d JOIN leaves l ON d.doc_id = l.doc_id AND d.bits = l.bits JOIN sums s ON s.depth = l.depth AND s.prefix = d.bits >> ({HASH_BITS} - l.depth)::INT
"""

OP8 = f"""
WITH lines AS (
  SELECT doc_id, row, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (SELECT *, translate({_TRIM.format("line")}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""

OP9 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS weight FROM totals),
running AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS nth,
    coalesce(sum(cap) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0) AS open_weight, sum(source_size) OVER () AS words
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * words - capped) / open_weight AS level FROM running),
chosen AS (SELECT coalesce((SELECT arg_min(level, nth) FROM levels WHERE weight * level <= cap), 1e300) AS level),
targets AS (SELECT coalesce('=' || w.source, '') AS key, w.source_size, least(w.weight * c.level, w.cap::DOUBLE) AS target FROM weighed w, chosen c),
sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, size, u, length(bin(size)) - 1 AS octave, greatest(floor(1 / sqrt(sqrt(greatest(size, 1)::DOUBLE)) * {UNIT}), 1)::BIGINT AS units FROM docs),
classed AS (
  SELECT *, CASE WHEN size > 0 THEN octave * 8 + (size >> greatest(octave - 3, 0)::INT) % 8 + 1 ELSE 0 END AS class,
    (units >> greatest(length(bin(units)) - 8, 0)::INT) << greatest(length(bin(units)) - 8, 0)::INT AS w
  FROM sized),
kinds AS (SELECT key, class, w, count(*) AS n, sum(size)::BIGINT AS words FROM classed GROUP BY ALL),
by_weight AS (SELECT key, w, sum(words)::BIGINT AS words FROM kinds WHERE words > 0 GROUP BY ALL),
shared AS (
  SELECT key, w, row_number() OVER (PARTITION BY key ORDER BY w DESC) AS nth, coalesce(sum(words) OVER before, 0) AS capped,
    (sum(w::HUGEINT * words) OVER (PARTITION BY key) - coalesce(sum(w::HUGEINT * words) OVER before, 0))::DOUBLE AS rest
  FROM by_weight WINDOW before AS (PARTITION BY key ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT s.*, (t.target - 2 * s.capped) / s.rest AS per FROM shared s JOIN targets t USING (key)),
per AS (SELECT t.*, l.per FROM targets t LEFT JOIN (SELECT key, arg_min(per, nth) AS per FROM levelled WHERE per * w <= 2 GROUP BY key) l USING (key)),
expected AS (SELECT k.*, p.source_size, p.target, coalesce(least(2.0, p.per * k.w), 2.0) AS copies FROM kinds k JOIN per p USING (key)),
chances AS (
  SELECT *, greatest(ceil(copies) - 1, 0)::BIGINT AS certain, CASE WHEN words > 0 THEN least(floor((copies - greatest(ceil(copies) - 1, 0)) * {UNIT}), {UNIT - 1})::BIGINT ELSE 0 END AS chance FROM expected),
strata AS (
  SELECT key, class, sum(chance::HUGEINT * words)::DOUBLE AS words, sum(chance::HUGEINT * n)::DOUBLE AS expected, sum(CASE WHEN chance > 0 THEN ({UNIT} - chance)::HUGEINT * words ELSE 0 END) AS spare,
    sum(CASE WHEN chance > 0 THEN n ELSE 0 END)::BIGINT AS n_open
  FROM chances GROUP BY ALL),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY class DESC) AS step, CASE WHEN expected > 0 THEN words / expected ELSE 1.0 END AS mean,
    coalesce(sum(spare) OVER (PARTITION BY key ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS later
  FROM strata),
walk AS (
  SELECT key, 0::BIGINT AS step, 0 AS class, 0::BIGINT AS take, 0.0::DOUBLE AS carry FROM per
  UNION ALL
  SELECT key, step, class, take, due - take * mean FROM (
    SELECT *, greatest(0, least(n_open, near + CASE WHEN due - near * mean > later / {UNIT} THEN 1 ELSE 0 END))::BIGINT AS take FROM (
      SELECT s.*, w.carry + s.words / {UNIT} AS due, floor((w.carry + s.words / {UNIT}) / s.mean + 0.5) AS near FROM walk w JOIN steps s ON s.key = w.key AND s.step = w.step + 1))),
drawn AS (
  SELECT d.doc_id, d.size, d.key, d.class, c.source_size, c.target, c.certain, CASE WHEN d.size > 0 AND c.chance > 0 THEN d.u / (1 - d.u) / (c.chance / ({UNIT} - c.chance)) END AS odds
  FROM classed d JOIN chances c ON d.key = c.key AND d.class = c.class AND d.w = c.w),
ranked AS (SELECT *, odds / (1 + odds) AS q FROM drawn),
placed AS (SELECT *, CASE WHEN q IS NOT NULL THEN count(*) OVER (PARTITION BY key, class, q IS NULL ORDER BY q) END AS place FROM ranked)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size::BIGINT AS source_size, p.target, (p.size * (p.certain + CASE WHEN p.place <= w.take THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN walk w ON w.key = p.key AND w.class = p.class AND w.step > 0
"""

OP12 = r"""
WITH rows AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM rows),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
counts AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1)),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f)::HUGEINT)::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.x JOIN counts y ON y.lang = c.lang AND y.phrase = c.y),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM counts WHERE m > 2))),
longest AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longest g USING (lang, phrase) WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
