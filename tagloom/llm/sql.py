"""DuckDB SQL of the registered queries which SQL can express over whole tables."""

from __future__ import annotations

_SPACES = r"[ \t\n\x0B\f\r]+"

_FILTER_AUDIT = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') AS words
  FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, list_filter([
    CASE WHEN len(words) < 50 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
    CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > first THEN 'E' END], lambda f: f IS NOT NULL) AS fails
  FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY part, fails),
orders AS (
  SELECT '' AS o, 0 AS k
  UNION ALL
  SELECT o || f, k + 1 FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(f) WHERE k < 5 AND NOT contains(o, f)
),
steps AS (
  SELECT o AS filter_order, i::INTEGER AS step, string_split(o[1:i - 1], '') AS done, o[i:i] AS filter
  FROM (SELECT o FROM orders WHERE k = 5), generate_series(1, 5) AS s(i)
),
facts AS (
  SELECT part, filter_order, step, filter, n, good, bad, list_contains(fails, filter) AS fail,
         list_has_any(fails, done) AS gone, fails = [filter] AS sole
  FROM counts, steps
),
found AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (sole), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM facts GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM found"""

_EXACT_DEDUP = rf"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY body)"""

_NGRAM_JOIN = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '{_SPACES}'), lambda w: w <> '') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingles
  FROM texts
),
sizes AS MATERIALIZED (SELECT doc_id, len(shingles) AS n FROM sets),
held AS MATERIALIZED (SELECT doc_id, n, hash(shingle) AS shingle FROM (SELECT doc_id, unnest(shingles) AS shingle FROM sets) JOIN sizes USING (doc_id)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS size_a, b.n AS size_b, count(*) AS shared
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
),
links AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * shared >= 90 * (size_a + size_b - shared)
  UNION ALL SELECT b, a FROM common WHERE 100 * shared >= 90 * (size_a + size_b - shared)
),
reached(doc_id, least) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  (SELECT l.b, min(r.least) FROM reached r JOIN links l ON l.a = r.doc_id JOIN recurring.reached o ON o.doc_id = l.b
   WHERE r.least < o.least GROUP BY l.b)
)
SELECT doc_id, n AS n_shingles, least AS component_id FROM sizes JOIN reached USING (doc_id)"""

SQL: dict[str, str] = {"op7_ngram_jaccard_join": _NGRAM_JOIN, "op11_exact_dedup": _EXACT_DEDUP, "op13_filter_audit": _FILTER_AUDIT}
