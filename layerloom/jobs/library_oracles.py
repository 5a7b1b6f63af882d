"""DuckDB SQL for the queries of the admission, status and export jobs."""

from layerloom.jobs.oracles import _DIALOGUE, _FLAGS, _ITEMS, _NEW, _VEC, CLEAN

_ADMIT = f"""f AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 7 <> 3 THEN CASE WHEN doc_id % 11 = 5 THEN '' ELSE 'Doc ' || doc_id END END AS title,
    CASE WHEN doc_id % 7 <> 3 THEN CASE WHEN doc_id % 13 = 6 THEN '' ELSE coalesce(source, '') END END AS guest, sha256({CLEAN}) AS hash,
    CASE WHEN doc_id % 10 = 9 THEN 'not a text file' WHEN doc_id % 7 = 3 THEN 'no header' WHEN doc_id % 11 = 5 THEN 'no title' WHEN doc_id % 13 = 6 OR source IS NULL THEN 'no guest' END AS rule FROM documents),
  g AS (SELECT hash, min(file_id) AS first FROM f WHERE rule IS NULL GROUP BY hash),
  a AS (SELECT file_id, title, guest, coalesce(rule, CASE WHEN first < file_id THEN 'duplicate' END) AS reject_reason, CASE WHEN rule IS NULL AND first < file_id THEN first END AS duplicate_of FROM f LEFT JOIN g USING (hash))"""
_LOST = "sp AS (SELECT passage_id, p % 9 = 4 OR (start_char = 0 AND length(content) = 0) AS bad FROM items WHERE passage_id % 5 <> 1)"
_MERGE = """r AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
  m(label, vec_id, k, g, cur, tok, likeness) AS (
    SELECT label, vec_id, k, 0, e, 60, CAST(NULL AS DOUBLE) FROM r WHERE k = 1
    UNION ALL
    SELECT label, vec_id, k, CASE WHEN fits THEN g ELSE g + 1 END, CASE WHEN fits THEN list_transform(half, lambda x: x / sqrt(list_dot_product(half, half))) ELSE e END, CASE WHEN fits THEN tok + 60 ELSE 60 END, s
    FROM (SELECT r.label, r.vec_id, r.k, m.g, m.tok, r.e, list_dot_product(m.cur, r.e) AS s, list_dot_product(m.cur, r.e) > 0.05 AND m.tok + 60 <= 400 AS fits, list_transform(list_zip(m.cur, r.e), lambda x: (x[1] + x[2]) / 2) AS half FROM m JOIN r ON r.label = m.label AND r.k = m.k + 1))"""
_ACTIONS = """actions AS (SELECT item_id, CASE WHEN length(content) % 3 = 0 THEN 'deleted' WHEN length(content) % 3 = 1 THEN 'resolved' ELSE 'empty content' END AS status, trim('fixed ' || content) AS new_content FROM flags WHERE length(content) % 2 = 1
  UNION ALL SELECT replace(item_id, ':propositions:', ':phrases:'), CASE WHEN layer = 'proposition' THEN 'invalid layer' ELSE 'deleted' END, '' FROM flags WHERE length(content) % 2 = 0)"""
_BLOCK = "string_agg(content, '|' ORDER BY start_char, id) FILTER (layer = '{}')"
_PAIRS = "pairs AS (SELECT c.passage_id, c.id AS claim, p.id AS proposition, list_cosine_similarity(c.e, p.e) AS similarity FROM v c JOIN v p ON p.passage_id = c.passage_id AND p.layer = 'proposition' WHERE c.layer = 'claim')"
_STAMPED = f"(SELECT *, id % 3 <> 0 AS stamped FROM {_DIALOGUE})"

_ANY_BLANK = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL = {
    "bulk_admission": f"WITH {_ADMIT} SELECT file_id, title, guest, reject_reason, coalesce(duplicate_of, -1) AS duplicate_of FROM a",
    "bulk_admission_counts": f"WITH {_ADMIT} SELECT coalesce(reject_reason, 'admitted') AS outcome, count(*) AS files FROM a GROUP BY 1",
    "hash_backfill": f"""WITH e AS (SELECT doc_id AS id, sha256({CLEAN}) AS hash FROM documents), t AS (SELECT * FROM e WHERE id % 3 = 0), f AS (SELECT min(id) AS id, hash FROM t WHERE hash NOT IN (SELECT hash FROM e WHERE id % 3 <> 0) GROUP BY hash)
      SELECT t.id, f.hash AS content_hash, CASE WHEN f.id IS NULL THEN 'skipped' ELSE 'updated' END AS action FROM t LEFT JOIN f USING (id)""",
    "semantic_merge": f"WITH RECURSIVE {_MERGE} SELECT CAST(label AS BIGINT) AS episode_id, vec_id AS position, CAST(g AS BIGINT) AS group_index, round(likeness, 3) AS likeness FROM m",
    "merge_report": f"WITH RECURSIVE {_MERGE} SELECT CAST(label AS BIGINT) AS episode_id, count(*) AS raw_passages, CAST(max(g) + 1 AS BIGINT) AS final_passages, CAST(count(*) - max(g) - 1 AS BIGINT) AS merges FROM m GROUP BY label",
    "bad_span_passages": f"WITH {_ITEMS}, {_LOST} SELECT DISTINCT passage_id FROM sp WHERE bad",
    "scope_status": f"""WITH {_ITEMS}, {_LOST}, n AS (SELECT passage_id AS id, bool_or(bad) AS bad FROM sp GROUP BY passage_id), c AS (SELECT c.*, n.bad IS NOT NULL AS has, coalesce(n.bad, false) AS bad FROM {_STAMPED} c LEFT JOIN n USING (id)),
      b AS (SELECT episode_id, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY id) AS r FROM c WHERE bad) WHERE r <= 10 GROUP BY episode_id)
      SELECT episode_id, count(*) AS total, count(*) FILTER (stamped OR has) AS done, count(*) FILTER (NOT (stamped OR has)) AS pending, count(*) FILTER (bad) AS bad_spans, coalesce(any_value(ids), '') AS first_bad FROM c LEFT JOIN b USING (episode_id) GROUP BY episode_id""",
    "missing_embeddings": f"WITH {_ITEMS}, u AS (SELECT 'chunk' AS kind, id % 7 = 2 AS gone FROM {_DIALOGUE} UNION ALL SELECT layer, p % 6 = 1 FROM items) SELECT kind, count(*) AS total, count(*) FILTER (gone) AS missing FROM u GROUP BY kind",
    "extraction_summary": f"""WITH {_ITEMS}, e AS (SELECT DISTINCT conv_id AS episode_id FROM conversations), n AS (SELECT episode_id, count(*) AS n, count(*) FILTER (stamped) AS done FROM {_STAMPED} WHERE episode_id % 10 <> 7 GROUP BY episode_id),
      u AS (SELECT episode_id, count(*) FILTER (layer = 'proposition') AS up, count(*) FILTER (layer = 'claim') AS uc FROM items WHERE needs_lookback AND episode_id % 10 <> 7 GROUP BY episode_id),
      x AS (SELECT episode_id, coalesce(n, 0) AS n, coalesce(done, 0) AS done, coalesce(up, 0) AS up, coalesce(uc, 0) AS uc FROM e LEFT JOIN n USING (episode_id) LEFT JOIN u USING (episode_id))
      SELECT count(*) AS episodes, count(*) FILTER (n > 0) AS with_passages, count(*) FILTER (n > 0 AND done = n) AS fully_layered, count(*) FILTER (done > 0 AND done < n) AS partial, count(*) FILTER (n > 0 AND done = 0) AS not_started, count(*) FILTER (n = 0) AS empty,
        CAST(sum(n) AS BIGINT) AS passages, CAST(sum(done) AS BIGINT) AS layered, CAST(sum(n - done) AS BIGINT) AS pending, CAST(sum(up) AS BIGINT) AS unresolved_propositions, CAST(sum(uc) AS BIGINT) AS unresolved_claims, CAST(sum(up + uc) AS BIGINT) AS unresolved, count(*) FILTER (up + uc > 0) AS with_unresolved FROM x""",
    "featured_episodes": f"SELECT episode_id, count(*) AS passages FROM {_DIALOGUE} GROUP BY episode_id ORDER BY episode_id DESC LIMIT 6",
    "model_label": f"""WITH {_ITEMS}, f AS (SELECT passage_id AS id, arg_min('m' || (length(content) % 3), id) AS first FROM items WHERE layer = 'proposition' GROUP BY passage_id),
      m AS (SELECT episode_id, CASE WHEN id % 4 = 0 THEN 'large' WHEN id % 4 = 1 THEN 'small' ELSE first END AS model FROM {_DIALOGUE} LEFT JOIN f USING (id)) SELECT episode_id, coalesce(string_agg(DISTINCT model, ', ' ORDER BY model), 'unknown') AS label FROM m GROUP BY episode_id""",
    "apply_resolutions": f"""WITH {_ITEMS}, {_FLAGS}, {_ACTIONS} SELECT item_id, passage_id, CASE WHEN status = 'resolved' THEN new_content ELSE content END AS content, status IS DISTINCT FROM 'resolved' AS needs_lookback
      FROM flags LEFT JOIN (SELECT * FROM actions WHERE status IN ('resolved', 'deleted')) USING (item_id) WHERE status IS DISTINCT FROM 'deleted'""",
    "resolution_status": f"WITH {_ITEMS}, {_FLAGS}, {_ACTIONS} SELECT item_id, status FROM actions",
    "delete_episodes": f"""WITH {_ITEMS} SELECT c.id, c.episode_id, c.passage_index, count(*) FILTER (i.layer = 'proposition') AS propositions, count(*) FILTER (i.layer = 'claim') AS claims, count(*) FILTER (i.layer = 'phrase') AS phrases
      FROM {_DIALOGUE} c LEFT JOIN items i ON i.passage_id = c.id WHERE c.episode_id % 4 <> 1 GROUP BY ALL""",
    "export_nested": f"""WITH {_ITEMS}, b AS (SELECT passage_id AS id, {_BLOCK.format('proposition')} AS a1, {_BLOCK.format('claim')} AS a2, {_BLOCK.format('phrase')} AS a3 FROM items GROUP BY passage_id)
      SELECT id, episode_id, passage_index, coalesce(a1, '') AS propositions, coalesce(a2, '') AS claims, coalesce(a3, '') AS phrases FROM {_DIALOGUE} LEFT JOIN b USING (id)""",
    "unresolved_export": f"""WITH {_ITEMS}, {_FLAGS}, b AS (SELECT passage_id AS id, {_BLOCK.format('proposition')} AS a1, {_BLOCK.format('claim')} AS a2 FROM items GROUP BY passage_id),
      w AS (SELECT id, coalesce(a1, '') AS propositions, coalesce(a2, '') AS claims, coalesce(array_to_string(list(a1) OVER (PARTITION BY episode_id ORDER BY passage_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS prior_propositions FROM {_DIALOGUE} LEFT JOIN b USING (id))
      SELECT item_id, episode_id, layer, content, propositions, claims, prior_propositions FROM flags JOIN w ON w.id = passage_id""",
    "extraction_trace": f"""WITH {_ITEMS}, {_FLAGS}, n AS (SELECT passage_id AS id, count(*) FILTER (layer = 'proposition' AND p % 8 <> 5) AS propositions, count(*) FILTER (layer = 'claim' AND p % 8 <> 5) AS claims, count(*) FILTER (layer = 'phrase' AND p % 8 <> 5) AS phrases, count(*) FILTER (p % 8 = 5) AS dropped FROM items GROUP BY passage_id),
      g AS (SELECT passage_id AS id, string_agg(item_id, ',' ORDER BY item_id) AS flagged FROM flags GROUP BY passage_id)
      SELECT id, episode_id, coalesce(propositions, 0) AS propositions, coalesce(claims, 0) AS claims, coalesce(phrases, 0) AS phrases, coalesce(dropped, 0) AS dropped, coalesce(flagged, '') AS flagged FROM {_DIALOGUE} LEFT JOIN n USING (id) LEFT JOIN g USING (id)""",
    "layer_set_ops": f"""WITH {_ITEMS}, {_NEW}, o AS (SELECT DISTINCT passage_id, layer, trim(content) AS key, true AS a FROM items), n AS (SELECT DISTINCT passage_id, layer, trim(content) AS key, true AS b FROM fresh)
      SELECT layer, count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed, count(*) FILTER (a AND b) AS shared FROM o FULL JOIN n USING (passage_id, layer, key) GROUP BY layer""",
    "pair_similarity": f"WITH {_VEC}, {_PAIRS} SELECT passage_id, claim, proposition, round(similarity, 4) AS similarity FROM pairs",
    "threshold_sweep": f"WITH {_VEC}, {_PAIRS} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (similarity >= t) AS pairs FROM pairs, (SELECT unnest([-0.2, 0.0, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS t) GROUP BY t",
    "sentence_bounds": rf"""SELECT doc_id, length(regexp_extract(substr(text, 1, a), '^(.*[.!?]{_ANY_BLANK}+)', 1, 's')) AS start, CASE WHEN r = '' THEN length(text) ELSE b + length(r) END AS "end"
      FROM (SELECT *, regexp_extract(substr(text, b + 1), '^(.*?[.!?](?:{_ANY_BLANK}+|$))', 1, 's') AS r FROM (SELECT *, length(text) // 3 AS a, length(text) // 2 AS b FROM documents))""",
    "highlight_parts": "SELECT doc_id, md5(substr(text, 1, a)) AS before, md5(substr(text, a + 1, b - a)) AS marked, md5(substr(text, b + 1)) AS after FROM (SELECT *, length(text) // 3 AS a, length(text) // 2 AS b FROM documents)",
}
