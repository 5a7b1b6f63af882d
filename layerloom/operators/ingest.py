"""From raw texts to final passages in one job: clean, cut into sentences, pack, embed by a plug-in, merge neighbours, number."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from layerloom import config
from layerloom.functions import text as T
from layerloom.operators import admission, episodes, packing
from layerloom.scratch import written


@dataclass
class Ingested:
    """The tables of one ingest: raw passages, their groups with likenesses, the log of merges, final passages, and counts for each episode."""

    raw: DataFrame
    merged: DataFrame
    log: DataFrame
    passages: DataFrame
    summary: DataFrame


def ingest(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = config.MERGE_THRESHOLD, cap: int = config.MERGE_MAX_TOKENS, max_tokens: int = config.PASSAGE_MAX_TOKENS, overlap: int = config.PASSAGE_OVERLAP) -> Ingested:
    """Whole ``texts`` (episode_id, text) to passages. The model is asked once for each raw passage, whose vector is written."""
    cleaned = texts.select("episode_id", T.clean("text").alias("text"))
    raw = packing.passage(cleaned, "episode_id", max_tokens=max_tokens, overlap=overlap, any_long_=packing.any_long(texts))
    raw = raw.withColumnsRenamed({"passage_index": "position", "token_estimate": "tokens"})
    raw = written(episodes.embedded(raw, embed, keep=("episode_id", "position", "content", "tokens")))
    merged = written(admission.merge_neighbours(raw, threshold, cap))
    final = episodes.final_passages(raw, merged)
    return Ingested(raw, merged, episodes.merge_log(merged), final, episodes.ingest_summary(texts, raw, final))
