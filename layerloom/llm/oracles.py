"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM pos) p JOIN win ON p.s = win.s AND p.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY encode(source) NULLS LAST) AS INT) AS k FROM s GROUP BY source),
w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS weight FROM t),
fill(step, full_) AS (
  SELECT 0, CAST([] AS INT[])
  UNION ALL
  SELECT step + 1, list_concat(full_, more) FROM (
    SELECT f.step, f.full_, (SELECT list(k) FROM w WHERE NOT list_contains(f.full_, k)
      AND weight * ((SELECT sum(total) FROM w) - coalesce((SELECT sum(3 * total) FROM w WHERE list_contains(f.full_, k)), 0))::DOUBLE / (SELECT sum(weight) FROM w WHERE NOT list_contains(f.full_, k)) > 3 * total) AS more
    FROM fill f) WHERE more IS NOT NULL),
done AS (SELECT full_ FROM fill ORDER BY step DESC LIMIT 1),
target AS (SELECT w.*, CASE WHEN list_contains(full_, k) THEN CAST(3 * total AS DOUBLE)
  ELSE weight * ((SELECT sum(total) FROM w) - coalesce((SELECT sum(3 * total) FROM w WHERE list_contains(full_, k)), 0))::DOUBLE / (SELECT sum(weight) FROM w WHERE NOT list_contains(full_, k)) END AS target FROM w, done),
o AS (SELECT s.doc_id, s.size, target.total, target.target, least(round_even(target.target, 0)::BIGINT, 3 * target.total) AS words,
       coalesce(sum(s.size) OVER (PARTITION BY target.k ORDER BY s.place, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM s JOIN target ON s.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, total AS source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, words - e * total - ahead)))) AS BIGINT) AS taken FROM o
"""

OP4 = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
k AS (SELECT doc_id, p, md5_number(x) AS x FROM s),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS r FROM k) WHERE r > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(CASE WHEN p - q <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM (SELECT doc_id, p, lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone)) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0) AS n, coalesce(spans, 0) AS spans,
  CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) + 1,
    2 * ((CASE WHEN i > len(a) THEN len(h) // 2 ELSE a[i] END) - (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)))), '') END AS h FROM d LEFT JOIN cuts USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.to_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""

OP11 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 100, 100 * list_unique(w) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, s AS step, o[s] AS x, o[: s - 1] AS before FROM (SELECT filter_order, o, unnest(range(1, 6)) AS s FROM orders)),
few AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
at_ AS (SELECT part, filter_order, step, x, n, good, toxic, fails[x] AS here, list_bool_or(list_concat([false], list_transform(before, lambda i: fails[i]))) AS gone, list_sum(list_transform(fails, lambda y: y::INT)) AS k FROM few, steps),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN here AND k = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM at_ GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score FROM v a, v WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = anchor_label AND vec_id <> anchor_id),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE p.r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

SQL = {"op1_decontamination": OP1, "op3_mixing": OP3, "op4_suffix_dedup": OP4, "op9_jaccard_join": OP9, "op11_filter_audit": OP11, "op13_hard_negatives": OP13}
