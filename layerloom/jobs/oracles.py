"""DuckDB SQL for the queries of the transcript jobs."""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ARTIFACT = "(length(x) < 4 OR contains(x, '©') OR contains(x, 'Copyright') OR regexp_matches(x, 'Page \\d+ of \\d+'))"
_START = r"(regexp_matches(x, '^#{1,6}\s+') OR regexp_matches(x, '^\*\*[^*]+:\*\*') OR regexp_matches(x, '^[A-Z][a-z]+:\s') OR regexp_matches(x, '^(?:[A-Z][a-z]+\s+){1,12}[A-Z][a-z]+$'))"
_LINES = rf"list_transform(string_split(text, chr(10)), lambda l: {_STRIP.format('l')})"
_KEPT = f"list_filter({_LINES}, lambda x: x = '' OR NOT {_ARTIFACT})"
_MARKED = f"list_transform({_KEPT}, lambda x: CASE WHEN x = '' THEN chr(2) WHEN {_START} THEN chr(2) || x ELSE x END)"
CLEAN = rf"regexp_replace(replace(regexp_replace(array_to_string({_MARKED}, chr(1)), '[\x01\x02]*\x02[\x01\x02]*', chr(10) || chr(10), 'g'), chr(1), ' '), '^[\n ]+|[\n ]+$', '', 'g')"
_TOKENS = r"greatest(1, len(regexp_extract_all({}, '\S+')))"
_PARAS = rf"list_filter(list_transform(regexp_split_to_array({{}}, '\n\s*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
_SENTS = rf"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?])[ \t]+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: {_STRIP.format('s')}), lambda s: s <> '')"


def _sentences(source: str, key: str, text: str) -> str:
    """(key, position, paragraph, sentence) in order."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1 AS position, i AS paragraph, sentence FROM (
      SELECT {key}, i, unnest(range(1, len(ss) + 1)) AS j, unnest(ss) AS sentence FROM (
        SELECT {key}, i, {_SENTS.format('p')} AS ss FROM (SELECT {key}, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT {key}, {_PARAS.format(text)} AS ps FROM {source}))))"""


def _passages(source: str) -> str:
    """CTEs that end in ``passages`` (doc_id, passage_index, content, token_estimate) from a relation (doc_id, text)."""
    return f"""
s AS ({_sentences(source, 'doc_id', 'text')}),
t AS (SELECT *, {_TOKENS.format('sentence')} AS tokens FROM s),
a AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(tokens) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
e AS (SELECT *, position + greatest(1, count(*) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 1 FOLLOWING AND 150 FOLLOWING) + CASE WHEN total - before <= 150 THEN 1 ELSE 0 END) AS last_ FROM a),
chain(doc_id, k, first_, last_, n) AS (
  SELECT doc_id, 0, position, last_, n FROM e WHERE position = 0
  UNION ALL
  SELECT c.doc_id, c.k + 1, e.position, e.last_, e.n FROM chain c JOIN e ON e.doc_id = c.doc_id AND e.position = greatest(c.last_ - 1, c.first_ + 1) WHERE c.last_ < c.n),
passages AS (SELECT c.doc_id, c.k AS passage_index,
  string_agg(CASE WHEN e.position = c.first_ THEN '' WHEN e.paragraph = p.paragraph THEN ' ' ELSE chr(10) || chr(10) END || e.sentence, '' ORDER BY e.position) AS content
  FROM chain c JOIN e ON e.doc_id = c.doc_id AND e.position >= c.first_ AND e.position < c.last_ LEFT JOIN e p ON p.doc_id = e.doc_id AND p.position = e.position - 1 GROUP BY c.doc_id, c.k)"""


_EPISODES = f"(SELECT doc_id AS id, 'Doc ' || doc_id AS title, source AS guest, sha256({CLEAN}) AS content_hash FROM documents)"
_DIALOGUE = "(SELECT conv_id * 100 + turn AS id, conv_id AS episode_id, turn AS passage_index, text AS content FROM conversations)"
_ITEMS = f"""items AS (SELECT s.id * 1000 + s.position AS id, s.id AS passage_id, c.episode_id, c.passage_index, ['proposition', 'claim', 'phrase'][s.position % 3 + 1] AS layer,
  s.sentence AS content, s.sentence AS source_text, strpos(c.content, s.sentence) - 1 AS start_char, s.position AS p,
  s.position % 3 <> 2 AND length(s.sentence) % 5 = 0 AS needs_lookback FROM ({_sentences(_DIALOGUE, 'id', 'content')}) s JOIN {_DIALOGUE} c ON c.id = s.id)"""
_FLAGS = """flags AS (SELECT passage_id || ':' || layer || 's:' || r AS item_id, passage_id, episode_id, passage_index, layer, content FROM (
  SELECT *, row_number() OVER (PARTITION BY passage_id, layer ORDER BY p) - 1 AS r FROM items) WHERE needs_lookback)"""
_PRIOR = f"(SELECT id, episode_id, passage_index, coalesce(array_to_string(list(content) OVER (PARTITION BY episode_id ORDER BY passage_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10) || chr(10)), '') AS prior FROM {_DIALOGUE})"
_APPLIED = """applied AS (SELECT item_id, passage_id, episode_id, CASE WHEN length(content) % 2 = 0 AND length(content) % 3 <> 0 THEN content || ' [resolved]' ELSE content END AS content,
  NOT (length(content) % 2 = 0 AND length(content) % 3 <> 0) AS needs_lookback FROM flags)"""
_NEW = "fresh AS (SELECT id, passage_id, layer, p, CASE WHEN p % 11 = 2 THEN content || ' (rev)' ELSE content END AS content, CASE WHEN p % 5 = 1 THEN source_text || '*' ELSE source_text END AS source_text FROM items WHERE p % 7 <> 3)"
_VEC = "v AS (SELECT vec_id AS id, ['chunk', 'proposition', 'claim', 'phrase'][vec_id % 4 + 1] AS layer, vec_id // 20 AS passage_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_HITS = """hits AS (SELECT * FROM (SELECT q.id AS query_id, v.layer, v.id, v.passage_id, 1 - list_cosine_similarity(v.e, q.e) AS distance,
  row_number() OVER (PARTITION BY q.id, v.layer ORDER BY 1 - list_cosine_similarity(v.e, q.e), v.id) AS r FROM v, v q WHERE q.id % 20 = 0) WHERE distance <= CASE WHEN layer = 'phrase' THEN 0.75 ELSE 0.8 END AND r <= 20)"""

_PLAIN = r"""regexp_replace(replace(translate(text, '‘’“”–—', '''''""--'), '…', '...'), '\s+', ' ', 'g')"""

SQL = {
    "clean_text": f"SELECT doc_id, {CLEAN} AS clean FROM documents",
    "content_hash": f"SELECT id, content_hash FROM {_EPISODES}",
    "token_stats": f"SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest FROM (SELECT source, {_TOKENS.format('text')} AS n FROM documents) GROUP BY source",
    "normalize_text": f"SELECT doc_id, {_STRIP.format(_PLAIN)} AS normal FROM documents",
    "truncate_snippet": rf"""SELECT doc_id, CASE WHEN length(one) <= 72 THEN one ELSE rtrim(regexp_replace(substr(one, 1, 72), ' [^ ]*$', '')) || '…' END AS snippet,
      CASE WHEN length(pre) > 200 THEN substr(pre, 1, 197) || '…' ELSE pre END AS preview FROM (SELECT doc_id, {_STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS one, {_STRIP.format("replace(text, chr(10), ' ')")} AS pre FROM documents)""",
    "parse_header": f"""SELECT doc_id, 'Doc ' || doc_id AS title, source AS guest, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE '2024-03-05' END AS date, length({_STRIP.format('text')}) AS body_chars FROM documents""",
    "dedupe_episodes": f"SELECT min(id) AS id, content_hash FROM {_EPISODES} GROUP BY content_hash",
    "sentences": f"SELECT doc_id AS episode_id, count(*) AS sentences, CAST(sum({_TOKENS.format('sentence')}) AS BIGINT) AS tokens FROM ({_sentences('documents', 'doc_id', 'text')}) GROUP BY doc_id",
    "passage_text": f"WITH RECURSIVE {_passages('documents')} SELECT doc_id AS episode_id, CAST(passage_index AS BIGINT) AS passage_index, content, {_TOKENS.format('content')} AS token_estimate FROM passages",
    "ingest_report": f"""WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, source, {CLEAN} AS text FROM documents), f AS (SELECT min(doc_id) AS doc_id FROM c GROUP BY text), d AS (SELECT c.* FROM c JOIN f USING (doc_id)), {_passages('d')}
      SELECT source, count(DISTINCT doc_id) AS episodes, count(*) AS passages, CAST(sum({_TOKENS.format('content')}) AS BIGINT) AS tokens FROM passages JOIN d USING (doc_id) GROUP BY source""",
    "library_page": f"SELECT id, title, guest FROM {_EPISODES} WHERE contains(lower(title), '1') OR contains(lower(guest), '1') ORDER BY id DESC LIMIT 20",
    "extraction_requests": f"SELECT id, 'Extract the layers of this passage:' || chr(10) || content AS request FROM {_DIALOGUE}",
    "episode_layer_status": """SELECT source AS episode_id, count(*) AS passages, count(l.doc_id) AS layered, CASE WHEN count(l.doc_id) = count(*) THEN 'fully_layered' WHEN count(l.doc_id) > 0 THEN 'partial' ELSE 'not_started' END AS status
      FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""",
    "pending_passages": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "passage_layer_counts": f"""WITH {_ITEMS} SELECT c.id, c.episode_id, c.passage_index, count(*) FILTER (i.layer = 'proposition') AS propositions, count(*) FILTER (i.layer = 'claim') AS claims, count(*) FILTER (i.layer = 'phrase') AS phrases
      FROM {_DIALOGUE} c LEFT JOIN items i ON i.passage_id = c.id GROUP BY ALL""",
    "flagged_items": f"WITH {_ITEMS}, {_FLAGS} SELECT * FROM flags",
    "prior_context": f"SELECT * FROM {_PRIOR}",
    "lookback_requests": f"WITH {_ITEMS}, {_FLAGS} SELECT passage_id, any_value(prior) AS prior, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM flags JOIN {_PRIOR} p ON p.id = passage_id GROUP BY passage_id",
    "apply_lookback": f"WITH {_ITEMS}, {_FLAGS}, {_APPLIED} SELECT * FROM applied",
    "lookback_summary": f"""WITH {_ITEMS}, {_FLAGS}, {_APPLIED} SELECT episode_id, count(*) AS flagged, count(DISTINCT passage_id) AS calls, count(*) FILTER (NOT needs_lookback) AS resolved,
      coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (needs_lookback), '') AS still_unresolved FROM applied GROUP BY episode_id""",
    "model_diff": f"""WITH {_ITEMS}, {_NEW}, o AS (SELECT passage_id, layer, trim(content) AS key, arg_max(source_text, id) AS s FROM items GROUP BY ALL), n AS (SELECT passage_id, layer, trim(content) AS key, arg_max(source_text, id) AS s FROM fresh GROUP BY ALL)
      SELECT passage_id, layer, key, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'source_span_changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (passage_id, layer, key)""",
    "model_diff_totals": f"""WITH {_ITEMS}, {_NEW}, u AS (SELECT layer, 1 AS o, 0 AS n FROM items UNION ALL SELECT layer, 0, 1 FROM fresh) SELECT layer, CAST(sum(o) AS BIGINT) AS old, CAST(sum(n) AS BIGINT) AS new, CAST(sum(n - o) AS BIGINT) AS delta FROM u GROUP BY ROLLUP (layer)""",
    "clear_layers": f"""WITH {_ITEMS} SELECT (SELECT count(*) FROM {_DIALOGUE} WHERE episode_id % 3 = 0) AS passages, count(DISTINCT passage_id) AS passages_with_rows, count(*) FILTER (layer = 'proposition') AS propositions,
      count(*) FILTER (layer = 'claim') AS claims, count(*) FILTER (layer = 'phrase') AS phrases FROM items WHERE episode_id % 3 = 0""",
    "export_layer": f"WITH {_ITEMS} SELECT episode_id, passage_index, start_char, id, content FROM items WHERE layer = 'claim'",
    "layer_sample": f"WITH {_ITEMS} SELECT id, layer, passage_id, content FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5('s' || id)) AS r FROM items) WHERE r <= 11 ORDER BY md5('s|' || id) LIMIT 32",
    "vector_norm": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings",
    "topk_layers": f"WITH {_VEC}, {_HITS} SELECT query_id, layer, id, round(distance, 4) AS distance FROM hits",
    "topk_retrieve": f"""WITH {_VEC}, {_HITS}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY distance, list_position(['chunk', 'proposition', 'claim', 'phrase'], layer), id) AS b FROM hits)
      SELECT query_id, place, passage_id, layer, id, similarity FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, list_position(['chunk', 'proposition', 'claim', 'phrase'], layer), id) AS place, passage_id, layer, id, round(1 - distance, 4) AS similarity FROM one WHERE b = 1) WHERE place <= 20""",
    "claim_dedupe": f"WITH {_VEC} SELECT c.id, c.passage_id, coalesce(max(list_cosine_similarity(c.e, p.e)), -1) >= 0.2 AS dropped FROM v c LEFT JOIN v p ON p.passage_id = c.passage_id AND p.layer = 'proposition' WHERE c.layer = 'claim' GROUP BY c.id, c.passage_id",
}

SQL |= {name + "_all": SQL[name] for name in ("topk_layers", "topk_retrieve")}
