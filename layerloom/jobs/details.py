"""Queries of the smaller steps: rows of a scope, cards, look-back marks and answers, totals, reports and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerloom.jobs.episodes import NOW, _now
from layerloom.jobs.library import _stamped
from layerloom.jobs.oracles import _APPLIED, _DIALOGUE, _FLAGS, _ITEMS, _NEW
from layerloom.jobs.queries import _items, _passages, _replies, _second_run, query
from layerloom.operators import episodes, layers, replies, status
from layerloom.scratch import scratch_dir
from layerloom.sources import transcripts
from layerloom.sources.tables import table

SQL: dict[str, str] = {}


@query
def scope_items(spark, d):
    """Items of the pending passages, by layer."""
    pending = episodes.select_passages(_stamped(spark, d), _items(spark, d).limit(0))
    return status.scope_rows(_items(spark, d), pending).groupBy("layer").agg(F.count("*").alias("items"), F.countDistinct("passage_id").alias("passages"))


SQL["scope_items"] = f"WITH {_ITEMS} SELECT layer, count(*) AS items, count(DISTINCT passage_id) AS passages FROM items WHERE passage_id % 3 = 0 GROUP BY layer"


def _talks(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("episode_id")).distinct().withColumn("title", F.concat(F.lit("Talk "), "episode_id"))


@query
def layer_cards(spark, d):
    return layers.sample_cards(_items(spark, d), _passages(spark, d), _talks(spark, d))


_CUT = r"regexp_replace(trim(content), '\s+', ' ', 'g')"
SQL["layer_cards"] = rf"""WITH {_ITEMS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5('s' || id)) AS r FROM items) WHERE r <= 11 ORDER BY md5('s|' || id) LIMIT 32)
  SELECT id, layer, passage_id, passage_index, episode_id, 'Talk ' || episode_id AS title, CASE WHEN length({_CUT}) <= 72 THEN {_CUT} ELSE rtrim(regexp_replace(substr({_CUT}, 1, 72), ' [^ ]*$', '')) || '…' END AS text FROM s"""


@query
def lookback_stamps(spark, d):
    """Look-back marked as done where it was asked, and cleared for every third episode."""
    passages = _passages(spark, d).withColumn("lookback_completed_at", F.lit(None).cast("timestamp"))
    done = episodes.mark_lookback(passages, layers.flagged(_items(spark, d)), _now())
    left = episodes.clear_stamps(done, passages.where("episode_id % 3 = 0"))
    return left.select("id", F.col("lookback_completed_at").cast("string").alias("lookback_completed_at"))


SQL["lookback_stamps"] = f"WITH {_ITEMS}, {_FLAGS} SELECT id, CASE WHEN episode_id % 3 <> 0 AND id IN (SELECT passage_id FROM flags) THEN '{NOW}' END AS lookback_completed_at FROM {_DIALOGUE}"


@query
def lookback_answers(spark, d):
    """Answers as JSON, one text for each passage, some of them broken, read and applied."""
    flags = layers.flagged(_items(spark, d))
    entries = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("item_id", F.concat("content", F.lit(" (said)")).alias("content")))).alias("resolved")))
    raw = flags.groupBy("passage_id").agg(F.when(F.col("passage_id") % 5 == 3, "{broken").otherwise(entries).alias("raw"))
    return layers.apply_lookback(flags, replies.lookback_answers(raw))


SQL["lookback_answers"] = f"""WITH {_ITEMS}, {_FLAGS} SELECT item_id, passage_id, episode_id, CASE WHEN passage_id % 5 = 3 THEN content ELSE content || ' (said)' END AS content, passage_id % 5 = 3 AS needs_lookback FROM flags"""


@query
def trace_totals(spark, d):
    items = _items(spark, d).withColumn("start_char", F.when(F.col("p") % 8 == 5, -1).otherwise(F.col("start_char")))
    return status.trace_totals(status.trace(_passages(spark, d), items, layers.flagged(items)))


SQL["trace_totals"] = f"""WITH {_ITEMS}, c AS (SELECT episode_id, count(*) AS passages FROM {_DIALOGUE} GROUP BY 1), n AS (SELECT episode_id, count(*) FILTER (layer = 'proposition' AND p % 8 <> 5) AS propositions, count(*) FILTER (layer = 'claim' AND p % 8 <> 5) AS claims,
  count(*) FILTER (layer = 'phrase' AND p % 8 <> 5) AS phrases, count(*) FILTER (p % 8 = 5) AS dropped, count(*) FILTER (needs_lookback) AS flagged FROM items GROUP BY 1)
  SELECT episode_id, passages, coalesce(propositions, 0) AS propositions, coalesce(claims, 0) AS claims, coalesce(phrases, 0) AS phrases, coalesce(dropped, 0) AS dropped, coalesce(flagged, 0) AS flagged FROM c LEFT JOIN n USING (episode_id)"""


@query
def comparison_reports(spark, d):
    """The report of each episode, with every one of its fields taken out of the JSON again."""
    items = _items(spark, d)
    fresh = _second_run(items)
    flags = layers.flagged(items)
    figures = layers.lookback_summary(layers.apply_lookback(flags, _replies(flags)))
    out = episodes.comparison_report(items, fresh, layers.model_diff(items, fresh), figures, ("first", "second"), _now())
    size = "struct<old: long, new: long, delta: long>"
    item = "array<struct<layer: string, p: long, content: string, source_text: string>>"
    schema = f"""header struct<old_model: string, new_model: string, at: string, passages: long>, lookback struct<flagged: long, calls: long, resolved: long, still_unresolved: string>,
      totals struct<propositions: {size}, claims: {size}, phrases: {size}, all: {size}>, passages array<struct<passage_index: long, passage_id: long, old: {item}, new: {item}, changes: array<struct<layer: string, change: string, key: string>>>>"""
    x = out.select("episode_id", F.from_json("document", schema).alias("x"))
    said = lambda name: F.sha2(F.array_join(F.flatten(F.transform("x.passages", lambda p: F.transform(p[name], lambda i: F.concat_ws(":", i.layer, i.p, i.content, i.source_text)))), "|"), 256).alias(f"{name}_sha256")
    changes = F.flatten(F.transform("x.passages", lambda p: F.transform(p.changes, lambda c: F.concat_ws(":", p.passage_id, c.layer, c.change, c.key))))
    totals = [F.col(f"x.totals.{k}.{s}").alias(f"{k}_{s}") for k in ("propositions", "claims", "phrases", "all") for s in ("old", "new", "delta")]
    return x.select("episode_id", "x.header.*", "x.lookback.*", *totals, F.array_join("x.passages.passage_id", ",").alias("ids"), said("old"), said("new"), F.sha2(F.array_join(F.array_sort(changes), "|"), 256).alias("changes_sha256"))


_SUMS = ", ".join(f"{e} AS {k}_{s}" for k, w in (("propositions", "layer = 'proposition'"), ("claims", "layer = 'claim'"), ("phrases", "layer = 'phrase'"), ("all", "true")) for s, e in (("old", f"count(*) FILTER ({w} AND run = 0)"), ("new", f"count(*) FILTER ({w} AND run = 1)"), ("delta", f"count(*) FILTER ({w} AND run = 1) - count(*) FILTER ({w} AND run = 0)")))
_LIST = "sha256(coalesce(string_agg(layer || ':' || p || ':' || content || ':' || source_text, '|' ORDER BY passage_index, passage_id, layer, p) FILTER (run = {}), ''))"
SQL["comparison_reports"] = f"""WITH {_ITEMS}, {_FLAGS}, {_APPLIED}, {_NEW},
  l AS (SELECT episode_id, count(*) AS flagged, count(DISTINCT passage_id) AS calls, count(*) FILTER (NOT needs_lookback) AS resolved, coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (needs_lookback), '') AS still_unresolved FROM applied GROUP BY episode_id),
  u AS (SELECT i.passage_id, i.layer, i.p, i.content, i.source_text, 0 AS run, i.episode_id, i.passage_index FROM items i UNION ALL SELECT f.passage_id, f.layer, f.p, f.content, f.source_text, 1, c.episode_id, c.passage_index FROM fresh f JOIN {_DIALOGUE} c ON c.id = f.passage_id),
  o AS (SELECT passage_id, layer, trim(content) AS key, arg_max(source_text, id) AS s FROM items GROUP BY ALL), n AS (SELECT passage_id, layer, trim(content) AS key, arg_max(source_text, id) AS s FROM fresh GROUP BY ALL),
  d AS (SELECT episode_id, string_agg(line, '|' ORDER BY line) AS changes FROM (SELECT passage_id, passage_id || ':' || layer || ':' || CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'source_span_changed' END || ':' || key AS line
    FROM o FULL JOIN n USING (passage_id, layer, key) WHERE o.s IS DISTINCT FROM n.s) x JOIN {_DIALOGUE} c ON c.id = x.passage_id GROUP BY episode_id),
  g AS (SELECT episode_id, count(DISTINCT passage_id) AS passages, {_SUMS}, array_to_string(list_transform(list_sort(list(DISTINCT passage_index * 1000000000 + passage_id)), lambda x: x % 1000000000), ',') AS ids, {_LIST.format(0)} AS old_sha256, {_LIST.format(1)} AS new_sha256 FROM u GROUP BY episode_id)
  SELECT g.*, 'first' AS old_model, 'second' AS new_model, '{NOW}' AS at, coalesce(flagged, 0) AS flagged, coalesce(calls, 0) AS calls, coalesce(resolved, 0) AS resolved, coalesce(still_unresolved, '') AS still_unresolved, sha256(coalesce(changes, '')) AS changes_sha256
  FROM g LEFT JOIN l USING (episode_id) LEFT JOIN d USING (episode_id)"""


@query
def export_files(spark, d):
    """Every episode's export as a file, named by its title and id, and read back."""
    transcripts.register(spark)
    folder = scratch_dir(spark)
    out = episodes.episode_export(_talks(spark, d), _passages(spark, d), _items(spark, d))
    slug = F.concat(F.regexp_replace(F.lower(F.concat(F.lit("Talk "), "episode_id")), "[^a-z0-9]+", "-"), F.lit("-"), "episode_id", F.lit(".json"))
    out.select(slug.alias("name"), "document").write.format("documents").mode("overwrite").save(folder)
    files = spark.read.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_name").alias("name"), "value")
    x = files.select("name", F.from_json("value", "title string, passage_count long, passages array<struct<content: string>>").alias("x"))
    return x.select("name", "x.title", "x.passage_count", F.sha2(F.array_join("x.passages.content", "|"), 256).alias("contents_sha256"))


SQL["export_files"] = f"""SELECT 'talk-' || episode_id || '-' || episode_id || '.json' AS name, 'Talk ' || episode_id AS title, count(*) AS passage_count, sha256(string_agg(content, '|' ORDER BY passage_index, id)) AS contents_sha256 FROM {_DIALOGUE} GROUP BY episode_id"""
