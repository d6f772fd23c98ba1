"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
q AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS t FROM q),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS t FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
h AS (SELECT DISTINCT r, p, n, item_id FROM d JOIN win USING (n, t)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM h) GROUP BY 1),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""

OP4 = """
WITH x AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS hx FROM documents),
g AS (SELECT r, doc_id, p, substr(hx, CAST(2 * p + 1 AS BIGINT), 100) AS k FROM (SELECT r, doc_id, hx, unnest(range(0, len(hx) // 2 - 49)) AS p FROM x WHERE len(hx) >= 100)),
m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
s AS (SELECT g.r, g.p FROM g JOIN m USING (k) WHERE m.d < g.doc_id),
e AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS island FROM e),
n AS (SELECT r, island, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY 1, 2),
t AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM n UNION ALL SELECT r, max(b), NULL FROM n GROUP BY r),
u AS (SELECT x.r, string_agg(substr(hx, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, len(hx) // 2) - a) AS BIGINT)), '' ORDER BY a) AS kept FROM t JOIN x USING (r) GROUP BY x.r),
c AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM n GROUP BY 1)
SELECT doc_id, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, CASE WHEN n_spans IS NULL THEN hx ELSE '' END))) AS kept_sha256 FROM x LEFT JOIN c USING (r) LEFT JOIN u USING (r)
"""

OP12 = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, e.id, a.label = e.label AS same, CAST(list_sum([a.v[i] * e.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE id % 100 = 0) a JOIN e ON a.id <> e.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5
"""
