"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm import bin_packing, decontamination, filter_audit, fingerprints, hard_negatives, id_files, language_model, mixing, oracles, quality, similarity_join, suffix_dedup, tokens, urls
from layerloom.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op2_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """``cache``: the folder of a cache that is kept; else a new one."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.default_tokenizer(), tokens.CountCache(spark, cache))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("shards")


def mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shard_words(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.encode_documents(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.text_scores(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(rows.withColumn("label", label))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_decontamination, op2_token_counts, op3_mixing, mix_shards, op4_suffix_dedup, op5_quality, op6_urls, op7_fingerprints, op8_token_ids, op9_jaccard_join, op10_lm_scores, op11_filter_audit, op12_best_fit_packing, op13_hard_negatives)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
