"""The corpus pipeline: quality, near duplicates, benchmark passages, the mix of sources, and token-id files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``. The last one numbers its rows by doc_id, as the files' format
asks; the order of the mix is that of the files that the stage before it writes.

Cases: a null text is empty; documents without an id, or that share one, are told apart by their texts; a null source is a
source of its own; with labels of one kind only all documents pass or none does, and without any none does; an empty table passes all stages; columns of any name
that the stages do not know pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerloom.llm import decontamination, id_files, mixing, quality, similarity_join, tokens
from layerloom.llm.common import scratch_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a Jaccard index of 0.8 or more stays."""
    return similarity_join.keep_first(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that it takes a document, written shard by shard in the order of each shard's shuffle."""
    return mixing.mixed_shards(docs)


def token_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, as they read back."""
    return id_files.encode_documents(docs, tokens.default_tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_id_stage),
]

#: Trained weights cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
