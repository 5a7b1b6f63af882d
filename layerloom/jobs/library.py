"""Queries of the admission, status and export jobs, over stand-ins that derive from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.functions import text as T
from layerloom.jobs.queries import _passages, _items, _second_run, _vectors, query
from layerloom.operators import admission, layers, status
from layerloom.sources.tables import table

THRESHOLDS = [-0.2, 0.0, 0.1, 0.2, 0.3, 0.5]


def _files(spark, d) -> DataFrame:
    """Documents as files: some of another kind, some without a header, a title or a guest."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    title = F.when(i % 11 == 5, "").otherwise(F.concat(F.lit("Doc "), i))
    guest = F.when(i % 13 == 6, "").otherwise(F.coalesce("source", F.lit("")))
    raw = F.when(i % 7 == 3, text).otherwise(F.concat(F.lit("Title: "), title, F.lit("\nGuest: "), guest, F.lit("\n──────\n\n"), text))
    name = F.concat(F.lit("doc_"), i, F.when(i % 10 == 9, ".pdf").otherwise(".txt"))
    return table(spark, d, "documents").select(i.cast("long").alias("file_id"), name.alias("name"), raw.alias("raw"))


def _stamped(spark, d) -> DataFrame:
    return _passages(spark, d).withColumn("stamped", F.col("id") % 3 != 0)


def _spanned(spark, d) -> DataFrame:
    """Items of some passages, of which some have lost their span."""
    lost = F.col("p") % 9 == 4
    return _items(spark, d).where("passage_id % 5 <> 1").withColumn("start_char", F.when(lost, 0).otherwise(F.col("start_char"))).withColumn("end_char", F.when(lost, 0).otherwise(F.col("end_char")))


@query
def bulk_admission(spark, d):
    return admission.admit(_files(spark, d)).select("file_id", "title", "guest", "reject_reason", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query
def bulk_admission_counts(spark, d):
    return admission.admission_counts(admission.admit(_files(spark, d)))


@query
def hash_backfill(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return admission.backfill_hashes(rows.withColumn("content_hash", F.when(F.col("id") % 3 != 0, T.content_hash(T.clean("text")))))


def _neighbours(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("episode_id"), F.col("vec_id").alias("position"), F.lit(60).alias("tokens"), "embedding")


@query
def semantic_merge(spark, d):
    merged = admission.merge_neighbours(_neighbours(spark, d), 0.05, 400)
    return merged.select("episode_id", "position", "group_index", F.round("likeness", 3).alias("likeness"))


@query
def merge_report(spark, d):
    return admission.merge_report(admission.merge_neighbours(_neighbours(spark, d), 0.05, 400))


@query
def bad_span_passages(spark, d):
    return status.bad_span_passages(_spanned(spark, d))


@query
def scope_status(spark, d):
    return status.scope_status(_stamped(spark, d), _spanned(spark, d))


@query
def missing_embeddings(spark, d):
    return status.missing_embeddings(_passages(spark, d).withColumn("embedded", F.col("id") % 7 != 2), _items(spark, d).withColumn("embedded", F.col("p") % 6 != 1))


@query
def extraction_summary(spark, d):
    passages = _stamped(spark, d)
    episodes = table(spark, d, "conversations").select(F.col("conv_id").alias("episode_id")).distinct()
    return status.summary(episodes, passages.where("episode_id % 10 <> 7"), _items(spark, d).where("episode_id % 10 <> 7"))


@query
def featured_episodes(spark, d):
    return status.newest(_passages(spark, d))


@query
def model_label(spark, d):
    passages = _passages(spark, d).withColumn("model", F.expr("CASE WHEN id % 4 = 0 THEN 'large' WHEN id % 4 = 1 THEN 'small' ELSE '' END"))
    return status.model_labels(passages, _items(spark, d).withColumn("model", F.concat(F.lit("m"), F.length("content") % 3)))


def _actions(flags: DataFrame) -> DataFrame:
    n = F.length("content")
    asked = flags.where(n % 2 == 1).select("item_id", F.when(n % 3 == 0, "delete").otherwise("set").alias("action"), F.when(n % 3 == 1, F.concat(F.lit(" fixed "), "content")).otherwise(" ").alias("content"))
    other = flags.where(n % 2 == 0).select(F.replace("item_id", F.lit(":propositions:"), F.lit(":phrases:")).alias("item_id"), F.lit("delete").alias("action"), F.lit("").alias("content"))
    return asked.unionByName(other)


@query
def apply_resolutions(spark, d):
    flags = layers.flagged(_items(spark, d))
    return status.apply_resolutions(flags, _actions(flags))[0]


@query
def resolution_status(spark, d):
    flags = layers.flagged(_items(spark, d))
    return status.apply_resolutions(flags, _actions(flags))[1]


@query
def delete_episodes(spark, d):
    gone = _passages(spark, d).where("episode_id % 4 = 1").select("episode_id").distinct()
    passages, items = status.delete_episodes(_passages(spark, d), _items(spark, d), gone)
    return layers.layer_counts(passages, items)


def _joined(name: str):
    return F.array_join(f"{name}", "|").alias(name)


@query
def export_nested(spark, d):
    rows = status.nested_export(_passages(spark, d), _items(spark, d))
    return rows.select("id", "episode_id", "passage_index", *[F.array_join(f"{v}.content", "|").alias(v) for v in ("propositions", "claims", "phrases")])


@query
def unresolved_export(spark, d):
    items = _items(spark, d)
    rows = status.unresolved_export(_passages(spark, d), items, layers.flagged(items))
    return rows.select("item_id", "episode_id", "layer", "content", *map(_joined, ("propositions", "claims", "prior_propositions")))


@query
def extraction_trace(spark, d):
    items = _items(spark, d).withColumn("start_char", F.when(F.col("p") % 8 == 5, -1).otherwise(F.col("start_char")))
    return status.trace(_passages(spark, d), items, layers.flagged(items))


@query
def layer_set_ops(spark, d):
    """How many content keys of a layer the second run added, removed and shares with the first."""
    items = _items(spark, d)
    change = F.col("change")
    return layers.model_diff(items, _second_run(items)).groupBy("layer").agg(F.count_if(change == "added").alias("added"), F.count_if(change == "removed").alias("removed"), F.count_if(~change.isin("added", "removed")).alias("shared"))


@query
def pair_similarity(spark, d):
    return status.pair_similarity(_vectors(spark, d)).withColumn("similarity", F.round("similarity", 4))


@query
def threshold_sweep(spark, d):
    return status.threshold_sweep(status.pair_similarity(_vectors(spark, d)), THRESHOLDS)


def _span():
    n = F.length("text")
    return F.col("text"), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")


@query
def sentence_bounds(spark, d):
    lo, hi = T.sentence_bounds(*_span())
    return table(spark, d, "documents").select("doc_id", lo.cast("long").alias("start"), hi.cast("long").alias("end"))


@query
def highlight_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[F.md5(c.cast("binary")).alias(k) for c, k in zip(T.highlight_parts(*_span()), ("before", "marked", "after"))])
