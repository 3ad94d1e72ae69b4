"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_URL = r"""
WITH caps AS (
  SELECT page_id, url, CAST(DATE '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS DATE) AS fetched,
         regexp_replace(regexp_replace(lower(regexp_extract(trim(url),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '^www\.', '') AS h,
         regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1),
           '^/+|/+$', '', 'g') AS p
  FROM pages),
raw AS (
  SELECT page_id // 3 AS n, string_split(url, '/')[3] AS host,
         regexp_split_to_array(string_split(url, '/')[4], '[?#]')[1] AS first
  FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL),
entries AS (
  SELECT ['ads', 'malware', 'allow'][1 + n % 3] AS list, CASE WHEN n % 4 = 3 THEN 'url' ELSE 'domain' END AS kind,
         host, first, CAST(DATE '2019-06-01' + CAST((n * 613) % 1600 AS INTEGER) AS DATE) AS day,
         CASE WHEN n % 5 >= 3 THEN 'remove' ELSE 'add' END AS action,
         regexp_replace(regexp_replace(lower(regexp_extract(host, '^([^/?#:]*)', 1)), '\.+$', ''), '^www\.', '') AS eh
  FROM raw WHERE host IS NOT NULL),
days AS (
  SELECT list, CASE WHEN kind = 'domain' THEN 'd:' || eh ELSE 'u:' || eh || '/' || first END AS value, day,
         max(action) AS action
  FROM entries WHERE eh <> '' AND (kind = 'domain' OR coalesce(first, '') <> '') GROUP BY 1, 2, 3),
spans AS (
  SELECT * FROM (SELECT list, value, day AS valid_from, action,
                        lead(day) OVER (PARTITION BY list, value ORDER BY day) AS valid_to FROM days)
  WHERE action = 'add'),
hits AS (
  SELECT c.page_id, c.url, c.fetched, s.list, s.value
  FROM caps c JOIN spans s ON c.h <> '' AND s.valid_from <= c.fetched AND (s.valid_to IS NULL OR c.fetched < s.valid_to)
   AND CASE WHEN s.value LIKE 'd:%' THEN ends_with('.' || c.h, '.' || s.value[3:])
            ELSE starts_with('u:' || c.h || '/' || c.p || '/', s.value || '/') END),
verdict AS (
  SELECT page_id, url, fetched, count(*) AS n_active, min(list || '|' || value) AS rule,
         bool_or(list IN ('ads', 'malware')) AND NOT bool_or(list = 'allow') AS blocked
  FROM hits GROUP BY 1, 2, 3)
SELECT c.page_id, c.fetched, coalesce(v.n_active, 0) AS n_active, v.rule, coalesce(v.blocked, false) AS blocked
FROM caps c LEFT JOIN verdict v ON c.page_id = v.page_id AND c.url = v.url AND c.fetched = v.fetched
"""

_MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5e0, 2e0, 1e0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER] AS weight,
         source_size * 3e0 AS cap FROM src),
level(step, x) AS (
  SELECT 0, 0e0
  UNION ALL
  SELECT * FROM (
    SELECT l.step + 1 AS step,
           ((SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(CASE WHEN w.weight * l.x >= w.cap THEN w.cap END), 0e0))
           / nullif(sum(CASE WHEN w.weight * l.x >= w.cap THEN 0e0 ELSE w.weight END), 0e0) AS x
    FROM level l, weighed w GROUP BY l.step, l.x HAVING l.step < 200) q
  WHERE q.x > (SELECT max(x) FROM level)),
rated AS (
  SELECT source, source_size, least(weight * (SELECT max(x) FROM level), cap) AS target,
         CASE WHEN source_size > 0 THEN least(least(weight * (SELECT max(x) FROM level), cap) / source_size, 3e0)
              ELSE 0e0 END AS rate
  FROM weighed),
units AS (
  SELECT source, doc_id, size, size * count(*) AS words FROM sized GROUP BY source, doc_id, size),
classed AS (
  SELECT *, greatest(len(bin(words)) - 6, 0)::BIGINT AS e, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM units),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY e * 64 + (words >> e) DESC, substr(h, 1, 8),
                               doc_id NULLS LAST, size) AS place FROM classed),
drawn AS (
  SELECT p.*, r.rate, r.rate - floor(r.rate) AS f, r.source_size, r.target,
         ('0x' || substr(md5('mix:' || coalesce('=' || p.source, '-')), 1, 8))::BIGINT / 4294967296e0 AS start
  FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source),
taken AS (
  SELECT s.doc_id, s.size, d.source_size, d.target,
         s.size * (floor(d.rate) + floor(d.place * d.f + d.start) - floor((d.place - 1) * d.f + d.start))::BIGINT AS taken
  FROM sized s JOIN drawn d ON s.source IS NOT DISTINCT FROM d.source AND s.doc_id IS NOT DISTINCT FROM d.doc_id
       AND s.size = d.size)
SELECT doc_id, size, source_size, target, taken FROM taken
"""

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
placed AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
windows AS (
  SELECT rid, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third
  FROM placed WINDOW o AS (PARTITION BY rid ORDER BY i)),
counted AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, word, second, third) AS k FROM windows WHERE third IS NOT NULL),
stretches AS (
  SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS n FROM counted WHERE k > 1),
repeated AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM stretches GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
line_counts AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT d.doc_id, d.lang, d.source, len(split.w)::BIGINT AS n_words,
         length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN split USING (rid) LEFT JOIN line_counts l USING (rid) LEFT JOIN repeated r USING (rid)),
measured AS (
  SELECT row_number() OVER () AS rid, *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_words
  FROM counts),
rates AS (
  UNPIVOT (SELECT rid, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, base_failed,
                  word_length, symbols, dup_lines, repeat_words FROM measured)
  ON word_length, symbols, dup_lines, repeat_words INTO NAME rule VALUE v),
rules(rule, least_spread, two_sided) AS (
  VALUES ('word_length', 500, true), ('symbols', 250, false), ('dup_lines', 150, false), ('repeat_words', 100, false)),
sketch AS (
  SELECT lang, source, rule, v - v % (1::BIGINT << greatest(length(bin(v)) - 8, 0)) AS bucket, count(*) AS n
  FROM rates WHERE NOT base_failed GROUP BY ALL),
levels AS (
  SELECT 'own' AS level, lang, source, rule, bucket, n FROM sketch
  UNION ALL SELECT 'lang', lang, '', rule, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 'all', '', '', rule, bucket, sum(n) FROM sketch GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM levels),
quartiles AS (
  SELECT level, lang, source, rule, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1,
         min(bucket) FILTER (4 * upto >= 3 * total) AS q3
  FROM ranked GROUP BY ALL),
fences AS (
  SELECT level, lang, source, rule, total,
         CASE WHEN two_sided THEN q1 - 3 * greatest(q3 - q1, least_spread) ELSE 0 END AS low,
         q3 + 3 * greatest(q3 - q1, least_spread) AS high
  FROM quartiles JOIN rules USING (rule)),
limits AS (
  SELECT o.lang, o.source, o.rule,
         CASE WHEN o.total >= 200 THEN o.low WHEN l.total >= 200 THEN l.low ELSE e.low END AS low,
         CASE WHEN o.total >= 200 THEN o.high WHEN l.total >= 200 THEN l.high ELSE e.high END AS high
  FROM fences o JOIN fences l ON l.level = 'lang' AND l.lang = o.lang AND l.rule = o.rule
  JOIN fences e ON e.level = 'all' AND e.rule = o.rule WHERE o.level = 'own'),
verdict AS (
  SELECT r.rid, bool_and(coalesce(r.v BETWEEN f.low AND f.high, false)) AS inside
  FROM rates r LEFT JOIN limits f USING (lang, source, rule) GROUP BY r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND inside AS kept
FROM measured JOIN verdict USING (rid)
"""

ORACLE = {"op1_url_filters": _URL, "op5_mix_sources": _MIX, "op11_quality_rules": _QUALITY}
