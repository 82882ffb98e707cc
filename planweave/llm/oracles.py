"""DuckDB SQL for the queries that SQL can express."""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.fine AND b.fine AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN component c ON v.vec_id = c.vec_id
"""

OP6 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN m.first IS NOT NULL AND m.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.first <> p.page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 1000
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE turn % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k, sum(weight) OVER (ORDER BY most / weight DESC, source DESC NULLS FIRST) AS after,
      coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
l AS (SELECT min_by(level, k) AS level FROM (SELECT k, ((SELECT sum(source_size) FROM w) - before)::DOUBLE / after AS level, most, weight FROM o) WHERE most > level * weight),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM l) * weight, most))::DOUBLE AS target FROM w),
r AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12), 3) AS whole FROM t),
b AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM r),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, size AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN whole < 3 AND (upto < rest OR (upto - own < rest AND upto >= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS w FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM iw WHERE len(words) > 0)),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
pos AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM dw, lens WHERE len(words) >= n),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS w FROM pos) p JOIN win USING (w)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
place AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
span AS (SELECT lang, unnest([list_slice(words, i, i + k - 1) FOR k IN range(1, 5) IF i + k - 1 <= len(words)]) AS ws FROM place),
f AS (SELECT lang, ws, count(*) AS a FROM span GROUP BY lang, ws HAVING count(*) >= 30),
cand AS (SELECT * FROM f WHERE len(ws) >= 2),
cut AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM cand),
scored AS (
  SELECT c.lang, c.ws, c.a, c.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, c.k) JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, c.k + 1, len(c.ws))),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
part AS (
  SELECT lang, c.a, list_slice(ws, i, i + m - 1) AS ws FROM cand c JOIN (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) inner_part(i, m) ON m < len(ws) AND i + m - 1 <= len(ws)),
longer AS (SELECT lang, ws, max(a) AS a FROM part GROUP BY lang, ws),
kept AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, l, r, score FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.ws = b.ws WHERE g.a IS NULL OR 100::HUGEINT * g.a < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

SQL = {"op5_embedding_dedup": OP5, "op6_warc": OP6, "op7_mixing": OP7, "op10_decontamination": OP10, "op12_collocations": OP12}
