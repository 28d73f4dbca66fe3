"""DuckDB SQL for the operators of this subpackage that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item, k, p FROM dw JOIN bw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP3 = """
WITH l AS (
  SELECT DISTINCT doc_id, source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
bp AS (SELECT c.source, list(line) AS lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n > pages * 0.03 GROUP BY c.source),
k AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS parts, lines IS NOT NULL AND text IS NOT NULL AS has,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM documents d LEFT JOIN bp ON d.source IS NOT DISTINCT FROM bp.source)
SELECT doc_id, source, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN has THEN len(parts) - len(kept) ELSE 0 END AS BIGINT) AS n_dropped,
  CASE WHEN has THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM k
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * CAST(p[2] AS HUGEINT))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = """
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, rhost, rpath, rverdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS i
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE i = 1
"""

OP6 = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
c AS (SELECT key, size, count(*) AS n FROM s GROUP BY key, size),
t AS (SELECT key, CAST(sum(size * n) AS BIGINT) AS source_size FROM c GROUP BY key),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS most FROM t),
v AS (
  SELECT *, most / weight AS room,
    ((SELECT sum(source_size) FROM t)::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY most / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
water AS (SELECT level FROM v WHERE room > level ORDER BY room, key LIMIT 1),
g AS (SELECT key, source_size, CASE WHEN (SELECT level FROM water) IS NULL THEN most ELSE least(most, weight * (SELECT level FROM water)) END AS target FROM v),
h AS (
  SELECT key, source_size, target, floor(rate) AS whole, rate - floor(rate) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM g)),
z AS (
  SELECT c.key, size, n, part, row_number() OVER (PARTITION BY c.key ORDER BY size DESC) AS i,
    CAST(('0x' || substr(md5('20:' || c.key || ':' || size), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM c JOIN h ON c.key = h.key),
f(key, i, size, extra, rest) AS (
  SELECT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE FROM h
  UNION ALL
  SELECT key, i, size, extra, due - extra::DOUBLE * size::DOUBLE FROM (
    SELECT key, i, size, due, greatest(0, least(n, CASE WHEN size > 0 THEN CAST(floor(due / greatest(size::DOUBLE, 1.0::DOUBLE) + u) AS BIGINT) ELSE CAST(floor(part * n::DOUBLE + u) AS BIGINT) END)) AS extra
    FROM (SELECT z.key, z.i, z.size, z.n, z.u, z.part, f.rest + z.part * z.n::DOUBLE * z.size::DOUBLE AS due FROM f JOIN z ON f.key = z.key AND z.i = f.i + 1))),
r AS (SELECT *, row_number() OVER (PARTITION BY key, size ORDER BY md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), doc_id NULLS LAST) AS rank FROM s)
SELECT r.doc_id, r.size, h.source_size, h.target, CAST(r.size * (h.whole + CASE WHEN rank <= f.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN h ON r.key = h.key JOIN f ON r.key = f.key AND r.size = f.size
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
b AS (SELECT x AS v, y AS o FROM l UNION SELECT y, x FROM l),
r(v, o) AS (SELECT v, o FROM b UNION SELECT r.v, b.o FROM r JOIN b ON r.o = b.v),
c AS (SELECT v, min(o) AS least_id FROM r GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least_id, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON v = w.doc_id
"""

# pieces of a text are words and what is between them; a piece goes with the sentence of the word before it
OP9 = f"""
WITH p0 AS (
  SELECT doc_id, i, x, i % 2 = odd AS word FROM (
    SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i, CASE WHEN regexp_matches(x[1], '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') THEN 1 ELSE 0 END AS odd
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents WHERE text IS NOT NULL))),
p1 AS (
  SELECT *, CASE WHEN word THEN translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS w, sum(CASE WHEN word THEN 1 ELSE 0 END) OVER o AS place,
    CASE WHEN word AND coalesce(lag(contains(x, chr(10)) OR regexp_matches(x, '[.!?][^-,;:_/@&=+.!?]')) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AND i > 2 THEN 1 ELSE 0 END AS fresh
  FROM p0 WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN place > 0 THEN sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) END AS k FROM p1),
s AS (SELECT doc_id, k, min(place) AS a, max(place) AS z FROM p WHERE word GROUP BY doc_id, k),
t AS (SELECT x.doc_id, x.k AS k, min(y.k) AS last, any_value(x.a) AS a, min(y.z) AS z FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k + 1 AND x.k + 20 AND y.z - x.a + 1 >= 20 GROUP BY x.doc_id, x.k),
d AS (SELECT doc_id, list(w ORDER BY i) AS w FROM p WHERE word GROUP BY doc_id),
e AS (SELECT doc_id, k, last, row_number() OVER (PARTITION BY array_to_string(w[a : z], ' ') ORDER BY doc_id, k) AS seen FROM t JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(CAST(k AS BIGINT), CAST(last AS BIGINT) + 1)) AS k FROM e WHERE seen > 1),
h AS (SELECT doc_id, string_agg(lo || '-' || (hi + 1), ',' ORDER BY lo) AS removed FROM (SELECT doc_id, min(k) AS lo, max(k) AS hi FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM g) GROUP BY doc_id, run) GROUP BY doc_id),
m AS (SELECT p.doc_id, string_agg(x, '' ORDER BY i) FILTER (g.k IS NULL) AS text, count(*) FILTER (word AND g.k IS NOT NULL) AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT doc_id, CAST(coalesce(gone, 0) AS BIGINT) AS n_words_removed, coalesce(removed, '') AS removed, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN h USING (doc_id)
"""

ORACLES = {"op8_ngram_join": OP8, "op9_span_dedup": OP9, "op1_decontaminate": OP1, "op3_line_dedup": OP3, "op4_topk": OP4, "op5_url_filter": OP5, "op6_mix": OP6}
