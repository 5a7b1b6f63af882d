"""Model tables: read from Parquet, or derived from the test tables by the rules that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.functions.text import clean, content_hash, sentences


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ddl(rows: DataFrame) -> str:
    """The columns of ``rows`` with their types, as DDL."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def episodes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), F.col("source").alias("guest"), content_hash(clean("text")).alias("content_hash"))


def dialogue_passages(conversations: DataFrame) -> DataFrame:
    return conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("episode_id"), F.col("turn").alias("passage_index"), F.col("text").alias("content"))


def items(passages: DataFrame) -> DataFrame:
    """Sentences as propositions, claims and phrases in turn, with their first place in the passage."""
    rows = passages.select(F.col("id").alias("passage_id"), "episode_id", "passage_index", F.col("content").alias("text"), F.posexplode(sentences("content")).alias("p", "s"))
    content = F.col("s.sentence")
    layer = F.element_at(F.array(*map(F.lit, ("proposition", "claim", "phrase"))), F.col("p") % 3 + 1)
    start = F.expr("locate(s.sentence, text)") - 1
    rows = rows.select((F.col("passage_id") * 1000 + F.col("p")).alias("id"), "passage_id", "episode_id", "passage_index", layer.alias("layer"), content.alias("content"), content.alias("source_text"), start.cast("long").alias("start_char"), F.col("p").cast("long").alias("p"))
    flag = (F.col("layer") != "phrase") & (F.length("content") % 5 == 0)
    return rows.withColumn("end_char", F.col("start_char") + F.length("content")).withColumn("needs_lookback", flag)


def vectors(embeddings: DataFrame) -> DataFrame:
    """Item vectors: layer by id modulo 4, passages of 20."""
    layer = F.element_at(F.array(*map(F.lit, ("chunk", "proposition", "claim", "phrase"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return embeddings.select(F.col("vec_id").alias("id"), layer.alias("layer"), F.floor(F.col("vec_id") / 20).cast("long").alias("passage_id"), "embedding")
