"""Registered queries of the transcript jobs, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions import text as T
from layerloom.functions import vectors as V
from layerloom.operators import packing, layers, replies, retrieval
from layerloom.sources import tables
from layerloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _passages(spark, d):
    return tables.dialogue_passages(table(spark, d, "conversations"))


def _items(spark, d):
    return tables.items(_passages(spark, d))


def _second_run(items: DataFrame) -> DataFrame:
    """Stand-in for another extraction run."""
    content = F.when(F.col("p") % 11 == 2, F.concat("content", F.lit(" (rev)"))).otherwise(F.col("content"))
    return items.where("p % 7 <> 3").withColumn("source_text", F.when(F.col("p") % 5 == 1, F.concat("source_text", F.lit("*"))).otherwise(F.col("source_text"))).withColumn("content", content)


def _replies(flags: DataFrame) -> DataFrame:
    n = F.length("content")
    return flags.where(n % 2 == 0).select("item_id", F.when(n % 3 == 0, F.col("content")).otherwise(F.concat("content", F.lit(" [resolved]"))).alias("reply"))


@query
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean("text").alias("clean"))


@query
def content_hash(spark, d):
    return tables.episodes(table(spark, d, "documents")).select("id", "content_hash")


@query
def token_stats(spark, d):
    n = T.token_estimate("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("tokens"), F.max(n).alias("longest"))


@query
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.match_normal("text").alias("normal"))


@query
def truncate_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated("text").alias("snippet"), T.preview("text").alias("preview"))


@query
def parse_header(spark, d):
    date = F.expr("CASE doc_id % 4 WHEN 0 THEN '05.03.2024' WHEN 1 THEN '2024-03-05' WHEN 2 THEN '03/05/2024' ELSE 'soon' END")
    raw = F.concat(F.lit("Title: Doc "), "doc_id", F.lit("\nGuest: "), "source", F.lit("\nDate: "), date, F.lit("\n──────\n\n"), "text")
    h = table(spark, d, "documents").select("doc_id", T.header(raw).alias("h"))
    return h.select("doc_id", "h.title", "h.guest", F.col("h.date").cast("string").alias("date"), F.length("h.body").cast("long").alias("body_chars"))


@query
def dedupe_episodes(spark, d):
    return tables.episodes(table(spark, d, "documents")).groupBy("content_hash").agg(F.min("id").alias("id")).select("id", "content_hash")


@query
def sentences(spark, d):
    rows = packing.sentence_rows(table(spark, d, "documents"), "doc_id")
    return rows.groupBy("episode_id").agg(F.count("*").alias("sentences"), F.sum("tokens").alias("tokens"))


@query
def passage_text(spark, d):
    return packing.passage(table(spark, d, "documents"), "doc_id")


@query
def ingest_report(spark, d):
    """The flagship: clean, hash, drop repeats, cut into passages, and count by source."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.clean("text").alias("text"))
    first = docs.groupBy(T.content_hash("text").alias("hash")).agg(F.min(F.struct("doc_id", "source", "text")).alias("first"))
    # source and id are the passageed text's key, so the passages need no join
    # cleaning shortens texts, so the raw ones tell whether one is too long for a row, without the work before
    long = packing.any_long(table(spark, d, "documents"))
    passages = packing.passage(first.select(F.struct("first.doc_id", "first.source").alias("key"), "first.text"), "key", any_long_=long)
    return passages.groupBy("episode_id.source").agg(F.countDistinct("episode_id.doc_id").alias("episodes"), F.count("*").alias("passages"), F.sum("token_estimate").alias("tokens"))


@query
def library_page(spark, d):
    page = tables.episodes(table(spark, d, "documents")).where(F.lower("title").contains("1") | F.lower("guest").contains("1"))
    return page.orderBy(F.desc("id")).limit(config.PAGE_SIZE).select("id", "title", "guest")


@query
def extraction_requests(spark, d):
    return replies.extraction_requests(_passages(spark, d))


@query
def episode_layer_status(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    marked = docs.join(labels.withColumn("extracted", F.lit(True)), "doc_id", "left")
    return layers.episode_status(marked.select(F.col("source").alias("episode_id"), F.coalesce("extracted", F.lit(False)).alias("extracted")))


@query
def pending_passages(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query
def passage_layer_counts(spark, d):
    return layers.layer_counts(_passages(spark, d), _items(spark, d))


@query
def flagged_items(spark, d):
    return layers.flagged(_items(spark, d))


@query
def prior_context(spark, d):
    return layers.prior_context(_passages(spark, d))


@query
def lookback_requests(spark, d):
    return layers.lookback_requests(_passages(spark, d), layers.flagged(_items(spark, d)))


@query
def apply_lookback(spark, d):
    flags = layers.flagged(_items(spark, d))
    return layers.apply_lookback(flags, _replies(flags))


@query
def lookback_summary(spark, d):
    return layers.lookback_summary(apply_lookback(spark, d))


@query
def model_diff(spark, d):
    items = _items(spark, d)
    return layers.model_diff(items, _second_run(items))


@query
def model_diff_totals(spark, d):
    items = _items(spark, d)
    return layers.model_diff_totals(items, _second_run(items))


@query
def clear_layers(spark, d):
    items = _items(spark, d)
    scope = _passages(spark, d).where("episode_id % 3 = 0").select("episode_id").distinct()
    return layers.clear_layers(_passages(spark, d), items, scope)[1]


@query
def export_layer(spark, d):
    return layers.export_rows(_items(spark, d), "claim")


@query
def layer_sample(spark, d):
    return layers.sample(_items(spark, d))


def _vectors(spark, d):
    return tables.vectors(table(spark, d, "embeddings"))


@query
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 4).alias("norm"))


def _queries(spark, d):
    """Every twentieth row; all rows are searched."""
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query
def topk_layers(spark, d):
    hits = _all_hits(spark, d)
    return hits.select("query_id", "layer", "id", F.round("distance", 4).alias("distance"))


@query
def topk_retrieve(spark, d):
    return retrieval.best_passages(_all_hits(spark, d))


def _all_hits(spark, d, **how):
    return retrieval.layer_hits(_vectors(spark, d), _queries(spark, d), 0.20, 0.25, **how)


@query
def topk_layers_all(spark, d):
    """The same rows by several blocks of queries, as many queries have them."""
    return _all_hits(spark, d, block_bytes=1 << 14).select("query_id", "layer", "id", F.round("distance", 4).alias("distance"))


@query
def topk_retrieve_all(spark, d):
    return retrieval.best_passages(_all_hits(spark, d, block_bytes=1 << 14))


@query
def claim_dedupe(spark, d):
    return retrieval.distinct_claims(_vectors(spark, d), 0.20)
