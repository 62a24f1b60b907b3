"""DuckDB SQL for the queries whose results SQL can say: op1, op3, op4 and op6."""

from __future__ import annotations

from quillon.llm import mixing

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w, least(13, len({_WORDS})) AS m FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM b WHERE m > 0),
n AS (SELECT DISTINCT m FROM g),
x AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: struct_pack(i := i, g := array_to_string(w[i:i + m - 1], ' ')))) AS x FROM d, n WHERE len(w) >= m),
o AS (SELECT doc_id, x.i AS i, m, item FROM x JOIN g USING (m) WHERE g.g = x.x.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM o)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP3 = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS node FROM documents WHERE trim(coalesce(text, ''), E' \\t\\n\\x0b\\f\\r') <> '' GROUP BY text),
w AS (SELECT node, {_WORDS} AS w FROM t),
s AS (SELECT node, g, count(*) AS c FROM (SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT node, sum(c) AS z FROM s GROUP BY 1),
p AS (SELECT a.node AS a, b.node AS b, sum(least(a.c, b.c)) AS same FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE same >= 0.8 * (x.z + y.z - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reach) AS (SELECT node, node FROM t UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS class_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN t USING (text) LEFT JOIN k USING (node)"""

OP4 = f"""
WITH d AS (SELECT doc_id, source AS src, len(list_filter(string_split(translate(coalesce(text, ''), E'\\t\\n\\x0b\\f\\r', '     '), ' '), lambda x: x <> '')) AS size,
 (CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE AS u FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY src IS NULL, encode(src)) - 1 AS nth FROM s),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM n),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl,
 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
v AS (SELECT *, (budget - fb) / wl AS level FROM f), o AS (SELECT arg_min(level, (cap / w, nth)) AS last FROM v WHERE cap >= level * w),
g AS (SELECT src, source_size, CASE WHEN last IS NULL THEN cap ELSE least(cap, last * w) END AS target FROM v, o),
k AS (SELECT src, length(bin(size)) - 1 AS k, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL),
kw AS (SELECT k.src AS src, k, words, 2.0::DOUBLE * words AS cap, (k + 1) * words::DOUBLE AS w, target FROM k JOIN g ON k.src IS NOT DISTINCT FROM g.src),
kf AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY src ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb,
 sum(w) OVER (PARTITION BY src) - coalesce(sum(w) OVER (PARTITION BY src ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl FROM kw),
kv AS (SELECT *, (target - fb) / wl AS level FROM kf), ko AS (SELECT src, arg_min(level, (cap / w, k)) AS last FROM kv WHERE cap >= level * w GROUP BY 1),
r AS (SELECT kv.src AS src, k, words, (CASE WHEN last IS NULL THEN cap ELSE least(cap, last * w) END) / words AS rate FROM kv LEFT JOIN ko ON kv.src IS NOT DISTINCT FROM ko.src),
l AS (SELECT g.src AS src, source_size, target, target - coalesce(whole, 0) AS lack FROM g LEFT JOIN (SELECT src, sum(floor(rate) * words) AS whole FROM r GROUP BY 1) q ON g.src IS NOT DISTINCT FROM q.src),
x AS (SELECT doc_id, size, u, source_size, target, lack, l.src AS src, coalesce(rate, 0) AS rate, coalesce(rate, 0) - floor(coalesce(rate, 0)) AS p
 FROM d JOIN l ON d.src IS NOT DISTINCT FROM l.src LEFT JOIN r ON d.src IS NOT DISTINCT FROM r.src AND size > 0 AND r.k = length(bin(size)) - 1),
y AS (SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS odds FROM x),
z AS (SELECT *, dense_rank() OVER (PARTITION BY src ORDER BY odds, doc_id, size) AS rank, sum(size) OVER (PARTITION BY src ORDER BY odds, doc_id, size) AS until FROM y WHERE odds IS NOT NULL),
c AS (SELECT src, arg_min(rank, (miss, rank)) AS cut FROM (SELECT src, rank, abs(lack - until) AS miss FROM z UNION ALL SELECT DISTINCT src, 0, abs(lack) FROM z) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(floor(rate) * size AS BIGINT) AS taken FROM y WHERE odds IS NULL
UNION ALL SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN rank <= cut THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM z JOIN c ON z.src IS NOT DISTINCT FROM c.src"""

_GROUP = "CAST(('0x' || substr(h, {0}, 5)) AS INTEGER)"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_GROUP.format(5 * g + 1)} >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT body, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (body)"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op3_near_duplicates": OP3, "op4_mix_sources": OP4, "op6_warc_revisits": OP6}
