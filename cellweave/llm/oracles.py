"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_FOLD.format("text"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_FOLD.format("text"))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT r, k, grams.n AS n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, k, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 13)) AS p FROM g JOIN m ON g.g = m.g WHERE doc_id > first),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.r, count(gone.r) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.r IS NULL) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a) c USING (r)
"""

OP9 = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
j AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.n, r.n) AS n,
    c.n IS NOT NULL AND r.n IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.n = r.n
),
k AS (SELECT pair_id, coalesce(min(n) FILTER (NOT same), max(n) + 1) - 1 AS n_prefix FROM j GROUP BY pair_id),
x AS (
  SELECT t.pair_id, side, n, n_prefix, role, n <= n_prefix AS common,
    '<|' || translate(coalesce(role, 'unknown'), '<|>' || chr(10) || chr(13), '_____') || '|>' || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN k ON t.pair_id = k.pair_id
),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, side, common ORDER BY n) AS last FROM x)
SELECT pair_id, CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (common AND side = 0), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (NOT common AND side = 0), '') AS chosen,
  coalesce(string_agg((last - length(body)) || '-' || last, ',' ORDER BY n) FILTER (NOT common AND side = 0 AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || body, '' ORDER BY n) FILTER (NOT common AND side = 1), '') AS rejected,
  coalesce(string_agg((last - length(body)) || '-' || last, ',' ORDER BY n) FILTER (NOT common AND side = 1 AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY pair_id
"""

OP11 = """
WITH d AS (SELECT *, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS place FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

_TERMS = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
k AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, k GROUP BY t, n),
p AS (SELECT f.t, doc_id, r, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(w) * n) // l))) AS impact FROM f JOIN g USING (t) JOIN d USING (r), k),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM q JOIN p USING (t) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 20
"""

OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS place FROM s WHERE alike) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor AS anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op6_debruijn": OP6, "op8_metric_join": OP8, "op9_preference": OP9, "op4_decontaminate": OP4, "op11_stateful_stream": OP11, "op12_interval_bounds": OP12, "op13_multi_index": OP13}
