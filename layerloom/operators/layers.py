"""Jobs over passages and their layered items: selection, counts, look-back, differences, exports, clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions.text import strip, truncated


def layer_counts(passages: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each layer per passage; children are counted before the join."""
    n = items.groupBy(F.col("passage_id").alias("id")).agg(*[F.count_if(F.col("layer") == k).alias(v) for k, v in config.LAYERS.items()])
    return passages.select("id", "episode_id", "passage_index").join(n, "id", "left").na.fill(0, list(config.LAYERS.values()))


def flagged(items: DataFrame) -> DataFrame:
    """Propositions and claims that need earlier context, named by passage, layer and place in the layer."""
    place = F.row_number().over(Window.partitionBy("passage_id", "layer").orderBy("p")) - 1
    plural = F.create_map(*[F.lit(x) for kv in config.LAYERS.items() for x in kv])[F.col("layer")]
    rows = items.withColumn("item_id", F.concat_ws(":", "passage_id", plural, place))
    return rows.where("needs_lookback").select("item_id", "passage_id", "episode_id", "passage_index", "layer", "content")


def prior_context(passages: DataFrame, n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """The texts of the last ``n`` existing passages before each, joined by blank lines."""
    before = Window.partitionBy("episode_id").orderBy("passage_index").rowsBetween(-n, -1)
    return passages.select("id", "episode_id", "passage_index", F.array_join(F.collect_list("content").over(before), "\n\n").alias("prior"))


def lookback_requests(passages: DataFrame, flags: DataFrame, n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """One request per passage with flagged items: the prior text and the items in order of id."""
    asked = flags.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "content"))).alias("items"))
    return asked.join(prior_context(passages, n), F.col("passage_id") == F.col("id")).select("passage_id", "prior", F.size("items").cast("long").alias("n_items"), F.array_join("items.item_id", ",").alias("item_ids"))


def apply_lookback(flags: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (item_id, reply): an empty, equal or missing one leaves the flag."""
    out = flags.join(replies, "item_id", "left")
    done = F.coalesce((F.col("reply") != "") & (F.col("reply") != F.col("content")), F.lit(False))
    return out.select("item_id", "passage_id", "episode_id", F.when(done, F.col("reply")).otherwise(F.col("content")).alias("content"), (~done).alias("needs_lookback"))


def lookback_summary(applied: DataFrame) -> DataFrame:
    open_ = F.array_join(F.array_sort(F.collect_list(F.when(F.col("needs_lookback"), F.col("item_id")))), ",")
    return applied.groupBy("episode_id").agg(F.count("*").alias("flagged"), F.countDistinct("passage_id").alias("calls"), F.count_if(~F.col("needs_lookback")).alias("resolved"), open_.alias("still_unresolved"))


def _keys(items: DataFrame, side: str) -> DataFrame:
    last = Window.partitionBy("passage_id", "layer", "key").orderBy(F.desc("id"))
    rows = items.withColumn("key", strip("content")).withColumn("r", F.row_number().over(last)).where("r = 1")
    return rows.select("passage_id", "layer", "key", F.col("source_text").alias(side), F.lit(True).alias(f"in_{side}"))


def model_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a second run added, removed, kept, or anchored elsewhere, by trimmed content; of equal keys the last counts."""
    both = _keys(old, "was").join(_keys(new, "now"), ["passage_id", "layer", "key"], "full_outer")
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "source_span_changed").otherwise("unchanged")
    return both.select("passage_id", "layer", "key", change.alias("change"))


def model_diff_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both runs per layer, and in all."""
    rows = old.select("layer", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("layer", F.lit(0).alias("o"), F.lit(1).alias("n")))
    return rows.rollup("layer").agg(F.sum("o").alias("old"), F.sum("n").alias("new"), F.sum(F.col("n") - F.col("o")).alias("delta"))


def clear_layers(passages: DataFrame, items: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items left, report) after the items of the episodes in ``scope`` are removed."""
    inside = items.join(scope, "episode_id", "left_semi")
    n = passages.join(scope, "episode_id", "left_semi").agg(F.count("*").alias("passages"))
    report = inside.agg(F.countDistinct("passage_id").alias("passages_with_rows"), *[F.count_if(F.col("layer") == k).alias(v) for k, v in config.LAYERS.items()])
    return items.join(scope, "episode_id", "left_anti"), n.join(report)


def sample(items: DataFrame, count: int = 32, seed: str = "s") -> DataFrame:
    """A seeded sample of each layer, cut to ``count``."""
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.md5(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"))))
    rows = items.withColumn("r", rank).where(F.col("r") <= (count + 2) // 3)
    return rows.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col("id").cast("string")).cast("binary"))).limit(count).select("id", "layer", "passage_id", "content")


def sample_cards(items: DataFrame, passages: DataFrame, episodes: DataFrame, count: int = 32, seed: str = "s") -> DataFrame:
    """``sample`` with each item's episode and title, and its text cut at a word; the sample is small, so it is broadcast to both joins."""
    rows = F.broadcast(sample(items, count, seed))
    rows = passages.select(F.col("id").alias("passage_id"), "episode_id", "passage_index").join(rows, "passage_id")
    rows = episodes.select("episode_id", "title").join(F.broadcast(rows), "episode_id", "right")
    return rows.select("id", "layer", "passage_id", "passage_index", "episode_id", "title", truncated("content").alias("text"))


def export_rows(items: DataFrame, layer: str) -> DataFrame:
    return items.where(F.col("layer") == layer).select("episode_id", "passage_index", "start_char", "id", "content").orderBy("passage_index", "start_char", "id")


def episode_status(passages: DataFrame) -> DataFrame:
    """Per episode: passages, layered ones (``extracted`` set) and a label."""
    n = passages.groupBy("episode_id").agg(F.count("*").alias("passages"), F.count_if("extracted").alias("layered"))
    return n.withColumn("status", F.when(F.col("layered") == F.col("passages"), "fully_layered").when(F.col("layered") > 0, "partial").otherwise("not_started"))
