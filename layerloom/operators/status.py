"""Selection and status of episodes, passages and items; resolutions, deletions and nested exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions.text import strip
from layerloom.functions.vectors import cosine


def bad_span_passages(items: DataFrame) -> DataFrame:
    """Passages with an item whose span is (0, 0)."""
    return items.where("start_char = 0 AND end_char = 0").select("passage_id").distinct()


def scope_status(passages: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """Per episode: passages, done ones (stamped or with items), pending ones, and the first ids with bad spans.

    The ids are ranked with a limit, which Spark applies before the shuffle, so a large episode sends few rows.
    """
    n = items.groupBy(F.col("passage_id").alias("id")).agg(F.bool_or((F.col("start_char") == 0) & (F.col("end_char") == 0)).alias("bad"))
    rows = passages.join(n, "id", "left").select("id", "episode_id", (F.col("stamped") | F.col("bad").isNotNull()).alias("done"), F.coalesce("bad", F.lit(False)).alias("bad"))
    counts = rows.groupBy("episode_id").agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("pending"), F.count_if("bad").alias("bad_spans"))
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("id"))
    first = rows.where("bad").withColumn("place", place).where(F.col("place") <= most)
    ids = first.groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_bad"))
    return counts.join(ids, "episode_id", "left").na.fill("", ["first_bad"])


def scope_rows(items: DataFrame, scope: DataFrame) -> DataFrame:
    """The items whose passage is in ``scope`` (id)."""
    return items.join(scope.select(F.col("id").alias("passage_id")).distinct(), "passage_id", "left_semi")


def missing_embeddings(passages: DataFrame, items: DataFrame) -> DataFrame:
    """Rows and those not embedded, for passages and each layer."""
    rows = passages.select(F.lit("chunk").alias("kind"), "embedded").unionByName(items.select(F.col("layer").alias("kind"), "embedded"))
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(~F.col("embedded")).alias("missing"))


def summary(episodes: DataFrame, passages: DataFrame, items: DataFrame) -> DataFrame:
    """One row of totals over episodes (episode_id), passages (stamped) and items, aggregated per episode first."""
    n = passages.groupBy("episode_id").agg(F.count("*").alias("n"), F.count_if("stamped").alias("done"))
    u = items.where("needs_lookback").groupBy("episode_id").agg(F.count_if(F.col("layer") == "proposition").alias("up"), F.count_if(F.col("layer") == "claim").alias("uc"))
    rows = episodes.select("episode_id").join(n, "episode_id", "left").join(u, "episode_id", "left").na.fill(0)
    has = F.col("n") > 0
    return rows.agg(
        F.count("*").alias("episodes"), F.count_if(has).alias("with_passages"), F.count_if(has & (F.col("done") == F.col("n"))).alias("fully_layered"), F.count_if((F.col("done") > 0) & (F.col("done") < F.col("n"))).alias("partial"),
        F.count_if(has & (F.col("done") == 0)).alias("not_started"), F.count_if(~has).alias("empty"), F.sum("n").alias("passages"), F.sum("done").alias("layered"), F.sum(F.col("n") - F.col("done")).alias("pending"),
        F.sum("up").alias("unresolved_propositions"), F.sum("uc").alias("unresolved_claims"), F.sum(F.col("up") + F.col("uc")).alias("unresolved"), F.count_if(F.col("up") + F.col("uc") > 0).alias("with_unresolved"),
    )


def newest(passages: DataFrame, count: int = 6) -> DataFrame:
    """The newest episodes with their numbers of passages."""
    return passages.groupBy("episode_id").agg(F.count("*").alias("passages")).orderBy(F.desc("episode_id")).limit(count)


def model_labels(passages: DataFrame, items: DataFrame) -> DataFrame:
    """Per episode the models of its passages: the passage's own, else its first proposition's; several are joined, none is ``unknown``."""
    first = items.where("layer = 'proposition'").groupBy(F.col("passage_id").alias("id")).agg(F.min_by("model", "id").alias("first"))
    rows = passages.join(first, "id", "left").select("episode_id", F.coalesce(F.nullif("model", F.lit("")), F.nullif("first", F.lit(""))).alias("model"))
    names = F.array_join(F.array_sort(F.collect_set("model")), ", ")
    return rows.groupBy("episode_id").agg(names.alias("label")).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.lit("unknown")))


def apply_resolutions(flags: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that are left, status of each action). Actions: (item_id, action ``set`` or ``delete``, content)."""
    text = strip(F.coalesce("new_content", F.lit("")))
    rows = actions.select("item_id", "action", F.col("content").alias("new_content")).join(flags.select("item_id", F.lit(True).alias("there")), "item_id", "left")
    status = F.when(~F.split("item_id", ":")[1].isin("propositions", "claims"), "invalid layer").when(F.col("there").isNull(), "not found").when((F.col("action") == "set") & (text == ""), "empty content").when(F.col("action") == "set", "resolved").otherwise("deleted")
    rows = rows.select("item_id", text.alias("new_content"), status.alias("status"))
    done = rows.where("status IN ('resolved', 'deleted')")
    left = flags.join(done, "item_id", "left").where("status IS NULL OR status <> 'deleted'")
    left = left.select("item_id", "passage_id", F.coalesce(F.when(F.col("status") == "resolved", F.col("new_content")), F.col("content")).alias("content"), F.col("status").isNull().alias("needs_lookback"))
    return left, rows.select("item_id", "status")


def delete_episodes(passages: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, items) without the episodes in ``gone``."""
    return passages.join(gone, "episode_id", "left_anti"), items.join(gone, "episode_id", "left_anti")


def nested_export(passages: DataFrame, items: DataFrame) -> DataFrame:
    """One row per passage with its layers as ordered arrays; each layer is gathered by passage before the join."""
    row = F.struct("start_char", "id", "content", "source_text")
    rows = items.groupBy(F.col("passage_id").alias("id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("layer") == k, row))).alias(v) for k, v in config.LAYERS.items()])
    out = passages.select("id", "episode_id", "passage_index", "content").join(rows, "id", "left")
    none = F.array().cast("array<struct<start_char:bigint,id:bigint,content:string,source_text:string>>")
    return out.select("id", "episode_id", "passage_index", "content", *[F.coalesce(v, none).alias(v) for v in config.LAYERS.values()])


def unresolved_export(passages: DataFrame, items: DataFrame, flags: DataFrame, n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """Each open item with the propositions and claims of its passage and the propositions of the ``n`` passages before."""
    blocks = nested_export(passages, items)
    before = Window.partitionBy("episode_id").orderBy("passage_index").rowsBetween(-n, -1)
    blocks = blocks.select("id", F.col("propositions.content").alias("propositions"), F.col("claims.content").alias("claims"), F.flatten(F.collect_list("propositions.content").over(before)).alias("prior_propositions"))
    return flags.join(blocks, F.col("passage_id") == F.col("id")).select("item_id", "episode_id", "passage_id", "layer", "content", "propositions", "claims", "prior_propositions")


def trace(passages: DataFrame, items: DataFrame, flags: DataFrame) -> DataFrame:
    """Per passage: items with a place in the text by layer, items without one, and the flagged ones."""
    n = items.groupBy(F.col("passage_id").alias("id")).agg(*[F.count_if((F.col("layer") == k) & (F.col("start_char") >= 0)).alias(v) for k, v in config.LAYERS.items()], F.count_if(F.col("start_char") < 0).alias("dropped"))
    f = flags.groupBy(F.col("passage_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("flagged"))
    return passages.select("id", "episode_id").join(n, "id", "left").join(f, "id", "left").na.fill(0).na.fill("", ["flagged"])


def pair_similarity(items: DataFrame) -> DataFrame:
    """Likeness of each claim to each proposition of its passage."""
    props = items.where("layer = 'proposition'").select("passage_id", F.col("id").alias("proposition"), F.col("embedding").alias("other"))
    return items.where("layer = 'claim'").join(props, "passage_id").select("passage_id", F.col("id").alias("claim"), "proposition", cosine("embedding", "other").alias("similarity"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs at or above each threshold, counted in one pass."""
    rows = pairs.agg(*[F.count_if(F.col("similarity") >= t).alias(str(i)) for i, t in enumerate(thresholds)])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(i)).alias("pairs")) for i, t in enumerate(thresholds)])))


def trace_totals(trace_rows: DataFrame) -> DataFrame:
    """Per episode the sums of ``trace``'s counts, and how many items are flagged."""
    flags = F.when(F.col("flagged") == "", 0).otherwise(F.size(F.split("flagged", ",")))
    return trace_rows.groupBy("episode_id").agg(F.count("*").alias("passages"), *[F.sum(c).alias(c) for c in (*config.LAYERS.values(), "dropped")], F.sum(flags.cast("long")).alias("flagged"))
