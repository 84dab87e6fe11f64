"""SQL equivalents of the queries that SQL can express, for the correctness gate."""

from __future__ import annotations

_NEWEST_PAGES = "SELECT id, arg_max(url, updated_at) AS url, arg_max(text_content, updated_at) AS text_content FROM scrape_cache GROUP BY id"

P2_FOUND = f"""
WITH pages AS ({_NEWEST_PAGES}),
large AS (SELECT id, text_content AS t FROM pages WHERE strlen(text_content) > 8000),
sized AS (
  SELECT id,
    list_max(list_transform(string_split(t, chr(10) || chr(10)), lambda x: strlen(x))) AS paragraph,
    list_max(list_transform(string_split(t, chr(10)), lambda x: strlen(x))) AS line,
    list_max(list_transform(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: strlen(x))) AS sentence,
    list_max(list_transform(string_split(replace(t, ' ', chr(10)), chr(10)), lambda x: strlen(x))) AS word
  FROM large)
SELECT id, CASE WHEN paragraph <= 8000 THEN 'paragraph' WHEN line <= 8000 THEN 'line' WHEN sentence <= 8000 THEN 'sentence' WHEN word <= 8000 THEN 'word' ELSE 'none' END AS boundary
FROM sized
"""

P3_FOUND = """
WITH texts AS (
  SELECT 'scrape_cache' AS table_name, id, arg_max(text_content, updated_at) AS t, 3 AS k, 0.6 AS threshold, 50 AS least FROM scrape_cache WHERE text_content IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'memory_facts', id, arg_max(text, updated_at), 1, 0.7, 1 FROM memory_facts WHERE text IS NOT NULL GROUP BY id),
words AS (SELECT *, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM texts),
sets AS (
  SELECT table_name, id, threshold, least, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: CASE WHEN k = 1 THEN w[i] ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END))) AS token
  FROM words WHERE len(w) >= k),
sizes AS (SELECT table_name, id, count(*) AS n FROM sets GROUP BY ALL),
kept AS (SELECT s.*, z.n FROM sets s JOIN sizes z USING (table_name, id) WHERE z.n >= s.least),
common AS (
  SELECT a.table_name, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, a.threshold, count(*) AS c
  FROM kept a JOIN kept b ON a.table_name = b.table_name AND a.token = b.token AND a.id < b.id GROUP BY ALL)
SELECT table_name, id_a, id_b FROM common WHERE c >= threshold * (na + nb - c) - 1e-9
"""

_NEIGHBOURS = """
WITH usable AS (
  SELECT owner_kind, id, CAST(arg_max(embedding, created_at) AS DOUBLE[]) AS v FROM vectors
  WHERE model = 'emb-v1' AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY owner_kind, id),
ranked AS (
  SELECT a.owner_kind, a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS similarity,
    row_number() OVER (PARTITION BY a.owner_kind, a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS r
  FROM usable a JOIN usable b ON a.owner_kind = b.owner_kind AND a.id <> b.id)
"""
P4_NEAREST = _NEIGHBOURS + "SELECT owner_kind, id, neighbour, similarity FROM ranked WHERE r <= 5"
P4_FOUND = _NEIGHBOURS + "SELECT DISTINCT owner_kind, least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM ranked WHERE r <= 5"

_REPEATED = f"""
WITH pages AS ({_NEWEST_PAGES}),
sites AS (SELECT url, min(lower(domain)) AS site FROM urls WHERE trim(domain) <> '' GROUP BY url),
documents AS (SELECT p.id, s.site, p.text_content AS t FROM pages p JOIN sites s USING (url) WHERE p.text_content <> ''),
lines AS (
  SELECT id, site, unnest(range(len(l))) AS line_no, unnest(list_transform(l, lambda x: trim(regexp_replace(lower(x), ' +', ' ', 'g'), ' '))) AS line
  FROM (SELECT id, site, string_split(t, chr(10)) AS l FROM documents)),
sizes AS (SELECT site, count(*) AS d FROM documents GROUP BY site),
repeated AS (
  SELECT l.site, l.line FROM lines l JOIN sizes z USING (site) WHERE l.line <> '' GROUP BY l.site, l.line, z.d
  HAVING count(DISTINCT l.id) >= 5 AND count(DISTINCT l.id) >= 0.2 * z.d)
"""
P5_FOUND = _REPEATED + "SELECT l.id, CAST(l.line_no AS INT) AS line_no FROM lines l JOIN repeated r USING (site, line)"
P5_CLEAN = (
    _REPEATED
    + """, gone AS (SELECT id, list(line_no) AS g FROM lines JOIN repeated USING (site, line) GROUP BY id)
SELECT p.id, CASE WHEN g.g IS NULL THEN p.text_content ELSE array_to_string(list_transform(list_filter(list_zip(string_split(p.text_content, chr(10)), range(len(string_split(p.text_content, chr(10))))), lambda x: NOT list_contains(g.g, x[2])), lambda x: x[1]), chr(10)) END AS text
FROM pages p LEFT JOIN gone g ON g.id = p.id"""
)

ORACLES: dict[str, str] = {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_nearest": P4_NEAREST, "p5_found": P5_FOUND, "p5_clean": P5_CLEAN}
