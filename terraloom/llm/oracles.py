"""DuckDB SQL for the operators that SQL can express, over whole tables."""

_RECORD = r"""'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
 || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({0}) || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') url, coalesce(html, '') html, substr(md5(CAST(page_id AS varchar)), 1, 2) rot, CASE WHEN rot IN ('00', '40', '80', 'c0') AND length(html) > 0 THEN '#' || substr(html, 2) ELSE coalesce(html, '') END theirs FROM pages),
n AS (SELECT greatest(1, (count(*) + 999) // 1000) f FROM p),
r AS (SELECT page_id, rot, CAST(('0x' || substr(md5(CAST(page_id AS varchar)), 1, 8)) AS bigint) % f warc_file, CAST(('0x' || substr(md5(CAST(page_id AS varchar)), 9, 8)) AS bigint) spot, {_RECORD.format('html')} a, {_RECORD.format('theirs')} b FROM p, n),
d AS (SELECT page_id, warc_file, spot, CAST(strlen(a) AS bigint) length, sha256(a) digest, CASE WHEN rot NOT IN ('01', '41', '81', 'c1') THEN sha256(b) END their_digest FROM r)
SELECT page_id, warc_file, row_number() OVER w - 1 AS position, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "offset", length, digest, their_digest, digest IS DISTINCT FROM their_digest damaged
FROM d WINDOW w AS (PARTITION BY warc_file ORDER BY spot, page_id, digest)"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS bigint) n FROM sh),
e AS (SELECT doc_id, unnest(s) s FROM sh),
m AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.b, c.root FROM c JOIN t ON t.a = c.id)
SELECT doc_id, n n_shingles, min(root) component_id FROM c JOIN n ON n.doc_id = c.id GROUP BY doc_id, n"""

LINES = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) ls FROM documents),
l AS (SELECT doc_id, i - 1 AS no, list_sort(list_distinct(list_filter(string_split(translate(lower(ls[i]), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda v: v <> ''))) ts FROM x, range(1, 1000000) q(i) WHERE i <= len(ls)),
g AS (SELECT ts, len(ts) n, row_number() OVER () id, min((doc_id, no)) f FROM l WHERE len(ts) > 0 GROUP BY ts),
w AS (SELECT id, n, unnest(ts) t FROM g),
df AS (SELECT t, count(*) c FROM w GROUP BY t),
p AS (SELECT id, t FROM w JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, t) <= n - (n * 8 + 9) // 10 + 1),
c AS (SELECT DISTINCT a.id a, b.id b FROM p a JOIN p b ON a.t = b.t AND a.id <> b.id),
m AS (SELECT a, min(y.f) f FROM c JOIN g x ON x.id = a JOIN g y ON y.id = b WHERE least(x.n, y.n) * 10 >= greatest(x.n, y.n) * 8 AND len(list_intersect(x.ts, y.ts)) * 18 >= (x.n + y.n) * 8 GROUP BY a),
r AS (SELECT doc_id, count(*) n_removed, string_agg(CAST(no AS varchar), ',' ORDER BY no) removed_lines FROM l JOIN g ON g.ts = l.ts LEFT JOIN m ON m.a = g.id WHERE (doc_id, no) > g.f OR (doc_id, no) > m.f GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(len(ls), 0) AS bigint) n_lines, coalesce(n_removed, 0) n_removed, coalesce(removed_lines, '') removed_lines FROM x LEFT JOIN r ON r.doc_id = x.doc_id"""

ORACLES = {"op4_ngram_jaccard": JACCARD, "op8_line_dedup": LINES, "op9_warc": WARC}
