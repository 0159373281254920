"""DuckDB SQL for the operators that SQL can express."""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n_shingles + nb.n_shingles - i)),
r AS (SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT node, min(c) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
"""

OP2 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400),
h AS (SELECT k, i, md5(b[i:i + 399]) AS h FROM w),
r AS (SELECT k, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
p AS (SELECT k, b, unnest(range(1, octet_length(b) + 1)) AS p FROM d),
m AS (SELECT p.k, p.p, p.b[p.p:p.p] AS byte, coalesce(max(r.i) OVER (PARTITION BY p.k ORDER BY p.p) >= p.p - 399, false) AS gone
  FROM p LEFT JOIN r ON r.k = p.k AND r.i = p.p),
f AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY k ORDER BY p) AS before FROM m),
s AS (SELECT k, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
  coalesce(string_agg(hex(byte), '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM f GROUP BY k)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (k)
"""

OP9 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

OP11 = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 9 AS h
  FROM t),
g AS (SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM g),
p AS (SELECT conv_id, depth, octet_length(encode(text)) AS b, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
n AS (SELECT path, any_value(depth) AS depth, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path),
k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[:-2]),
a AS (SELECT path AS top, path, n_children, n_convs, b, depth FROM m UNION ALL SELECT top[:-2], path, n_children, n_convs, b, depth FROM a WHERE len(top) > 0),
s AS (SELECT top AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens FROM a GROUP BY top),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY p.path)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN e ON e.path = m.path
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP13 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(md5(text), '')))[:13])::BIGINT / 4503599627370496 AS coin
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS sizes, coalesce(sum(weight) OVER before, 0) AS weights, sum(source_size) OVER () AS size_all,
    sum(weight) OVER () AS weight_all
  FROM w WINDOW before AS (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (3 * size_all - 4 * sizes) > 4 * source_size * (weight_all - weights) AS stopped FROM o),
l AS (SELECT (3 * sum(source_size) - 4 * coalesce(sum(source_size) FILTER (stopped), 0))::DOUBLE / 2 / (sum(weight) FILTER (NOT stopped))::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN stopped THEN 2 * source_size::DOUBLE ELSE weight * level END AS target FROM c, l),
r AS (SELECT doc_id, size, source_size, target, coin, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (coin < rate - floor(rate))::INT))::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2, "op8_minhash_near_dedup": OP8, "op9_nearest_neighbours": OP9, "op11_conversation_prefix_trie": OP11,
            "op12_hard_negatives": OP12, "op13_source_mixing": OP13}
