"""DuckDB SQL of the operators that SQL can express."""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""

OP5 = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w WHERE regexp_matches(k, '\S')),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE r > 1),
g AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM c GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.doc_id = c.doc_id AND b.p = c.p - 1) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.n IS NULL THEN d.text ELSE array_to_string(list_filter(ls, lambda x, k: NOT list_contains(g.gone, k)), chr(10)) END AS text,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?]+\s+|\n+|\z)') AS ss FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS x FROM d),
v AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '') AS plain, length(x) AS n, len(regexp_extract_all(x, '[^ \t\n\r\f\v]+')) AS w FROM u),
t AS (SELECT *, sum(w) OVER o AS upto, sum(n) OVER o AS ending FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i > a.i AND b.upto - a.upto + a.w >= 16 GROUP BY ALL),
k AS (SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i > a.i AND b.upto - a.upto + a.w >= 16 GROUP BY b.doc_id, b.i),
r AS (SELECT * FROM f UNION SELECT * FROM k UNION SELECT doc_id, i, i FROM t WHERE w >= 32),
e AS (SELECT r.doc_id, r.i, r.j, (SELECT string_agg(plain, chr(10) ORDER BY t.i) FROM t WHERE t.doc_id = r.doc_id AND t.i BETWEEN r.i AND r.j) AS body FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM e),
c AS (SELECT DISTINCT o.doc_id, t.i FROM o JOIN t ON t.doc_id = o.doc_id AND t.i BETWEEN o.i AND o.j WHERE nth > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
m AS (SELECT doc_id, sum(n) AS n FROM c JOIN t USING (doc_id, i) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.doc_id = c.doc_id AND b.i = c.i - 1) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string(list_filter(ss, lambda x, q: NOT list_contains(g.gone, q)), '') END AS text,
  CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS ss FROM w WHERE len(ws) > 0),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT r.a AS doc_id, min(r.b) AS class_id, CAST((SELECT count(*) FROM p WHERE p.a = r.a) AS BIGINT) AS n_links FROM r GROUP BY r.a
"""

ORACLES: dict[str, str] = {"op2_substring_dedup": OP2, "op4_warc": OP4, "op5_line_dedup": OP5, "op7_jaccard_join": OP7}
