"""SQL of the corpus queries that SQL can express, for DuckDB. Regular expressions and patterns as in the contracts."""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT r, i, w, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS k, lead(i, 34) OVER (PARTITION BY r ORDER BY i) IS NOT NULL AS full_window FROM w),
n AS (SELECT k FROM g WHERE full_window GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, i, w, CASE WHEN full_window AND n.k IS NOT NULL THEN 1 ELSE 0 END AS dup FROM g LEFT JOIN n ON g.k = n.k),
m AS (SELECT r, i, w, max(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.r = m.r GROUP BY d.r, d.doc_id, len(d.ws)
"""

OP6 = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
own AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('block', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits AS (
  SELECT o.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY o.page_id ORDER BY length(r.rule) DESC) AS n
  FROM own o JOIN rules r ON (o.host = r.h OR ends_with(o.host, '.' || r.h)) AND starts_with(o.path, r.p))
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM own o LEFT JOIN fits f ON o.page_id = f.page_id AND f.n = 1
"""

OP8 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, list_distinct(list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '')) AS ws FROM l),
cl AS (SELECT line, any_value(ws) AS ws, len(any_value(ws)) AS n, min((doc_id, pos)) AS place FROM w WHERE len(ws) > 0 GROUP BY line),
e AS (SELECT place, n, unnest(ws) AS tok FROM cl),
o AS (SELECT place, n, tok, row_number() OVER (PARTITION BY place ORDER BY c, tok) AS i FROM e JOIN (SELECT tok, count(*) AS c FROM e GROUP BY tok) USING (tok)),
p AS (SELECT place, n, tok FROM o WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.place AS p1, b.place AS p2 FROM p a JOIN p b ON a.tok = b.tok AND a.place < b.place AND least(a.n, b.n) >= 0.8::DOUBLE * greatest(a.n, b.n) - 1e-9),
v AS (SELECT c.p2 AS place, a.n + b.n AS n, len(list_intersect(a.ws, b.ws)) AS o FROM c JOIN cl a ON a.place = c.p1 JOIN cl b ON b.place = c.p2),
gone AS (SELECT DISTINCT place FROM v WHERE o >= 0.8::DOUBLE * (n - o) - 1e-9),
keep AS (SELECT place FROM cl WHERE place NOT IN (SELECT place FROM gone)),
k AS (SELECT w.doc_id, w.pos, w.line, len(ws) = 0 OR keep.place IS NOT NULL AS stays FROM w LEFT JOIN keep ON keep.place = (w.doc_id, w.pos)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS kept FROM k GROUP BY 1)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS text_sha256 FROM t
UNION ALL SELECT doc_id, 1, 0, NULL FROM documents WHERE text IS NULL
"""
