"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

# The thresholds' parameters (200 documents, levels, 4 interquartile ranges, 32 at least) stand here as plain numbers.
QUALITY = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), lines AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM words
), windows AS (
  SELECT rid, i, list_slice(ws, i, i + 7) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM words)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid
), stats AS (
  SELECT l.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM lines l LEFT JOIN repeated r ON l.rid = r.rid
), cells AS (
  SELECT rid, lang, source, 'symbols_pm' AS metric, n_symbols * 1000 // n_words AS v FROM stats WHERE n_words > 0
  UNION ALL SELECT rid, lang, source, 'dup_lines_pm', n_dup_lines * 1000 // n_lines FROM stats WHERE n_words > 0
  UNION ALL SELECT rid, lang, source, 'repeat_pm', n_repeat_words * 1000 // n_words FROM stats WHERE n_words > 0
  UNION ALL SELECT rid, lang, source, 'word_len_c', word_chars * 100 // n_words FROM stats WHERE n_words > 0
), low AS (
  SELECT *, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS low FROM cells
), levels AS (
  SELECT * FROM (VALUES ('symbols_pm', 90), ('dup_lines_pm', 99), ('repeat_pm', 99), ('word_len_c', 75)) AS t(metric, level)
), grouped AS (
  SELECT 1 AS kind, lang, source, metric, low, count(*) AS c FROM low GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, metric, low, count(*) FROM low GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, low, count(*) FROM low GROUP BY ALL
), run AS (
  SELECT *, sum(c) OVER (PARTITION BY kind, lang, source, metric ORDER BY low) AS upto,
         sum(c) OVER (PARTITION BY kind, lang, source, metric) AS n FROM grouped
), marks AS (
  SELECT kind, lang, source, r.metric, max(n) AS n, min(low) FILTER (upto * 100 >= n * 25) AS q1,
         min(low) FILTER (upto * 100 >= n * 75) AS q3, min(low) FILTER (upto * 100 >= n * (100 - level)) AS lo,
         min(low) FILTER (upto * 100 >= n * level) AS hi
  FROM run r JOIN levels l ON r.metric = l.metric GROUP BY kind, lang, source, r.metric
), used AS (
  SELECT o.lang, o.source, o.metric, CASE WHEN o.n >= 200 THEN o ELSE CASE WHEN l.n >= 200 THEN l ELSE a END END AS m
  FROM (SELECT * FROM marks WHERE kind = 1) o
  JOIN (SELECT * FROM marks WHERE kind = 2) l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric
  JOIN (SELECT * FROM marks WHERE kind = 3) a ON o.metric = a.metric
), limits AS (
  SELECT lang, source, metric, m.lo AS lo, m.hi AS hi, greatest(4 * (m.q3 - m.q1), 32) AS far FROM used
), bad AS (
  SELECT DISTINCT c.rid FROM cells c JOIN limits m
    ON c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source AND c.metric = m.metric
  WHERE c.v > m.hi + m.far OR (c.metric = 'word_len_c' AND c.v < m.lo - m.far)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM stats
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": QUALITY}
