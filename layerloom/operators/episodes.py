"""Whole steps of a transcript library: final passages of an episode, stored layers, scopes, lists, search results and exports."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions import text as T
from layerloom.functions.vectors import normalised
from layerloom.scratch import scratch_dir, written

#: Headings of the sections that a look-back request has of each passage before; ``{}`` is the passage's index.
TEXT_HEAD, SAID_HEAD = "[passage {}: text]", "[passage {}: propositions]"
ITEM = "passage_id long, layer string, p long, content string, source_text string, start_char long, end_char long, needs_lookback boolean"


def final_passages(passages: DataFrame, merged: DataFrame) -> DataFrame:
    """(episode_id, passage_index, content, token_estimate, raw_indices, group_tokens) after neighbours are merged.

    ``passages``: (episode_id, position, content); ``merged``: their groups. A group's texts meet in one row; a group has
    at most as many tokens as the cap of the merge.
    """
    rows = passages.select("episode_id", "position", "content").join(merged.select("episode_id", "position", "group_index", "tokens"), ["episode_id", "position"])
    groups = rows.groupBy("episode_id", "group_index").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("parts"), F.sum("tokens").alias("group_tokens"))
    content = F.aggregate("parts", F.lit(""), lambda acc, x: T.joined_passages(acc, x.content))
    out = groups.select("episode_id", F.col("group_index").alias("passage_index"), content.alias("content"), F.array_join(F.transform("parts.position", lambda x: x.cast("string")), ",").alias("raw_indices"), "group_tokens")
    return out.withColumn("token_estimate", T.token_estimate("content"))


def merge_log(merged: DataFrame) -> DataFrame:
    """(episode_id, raw_index_a, raw_index_b, similarity, combined_tokens) of each merge."""
    by = Window.partitionBy("episode_id").orderBy("position")
    inside = Window.partitionBy("episode_id", "group_index").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = merged.withColumn("raw_index_a", F.lag("position").over(by)).withColumn("same", F.lag("group_index").over(by) == F.col("group_index")).withColumn("combined_tokens", F.sum("tokens").over(inside))
    return rows.where("same").select("episode_id", "raw_index_a", F.col("position").alias("raw_index_b"), F.round("likeness", 3).alias("similarity"), "combined_tokens")


def ingest_summary(raw: DataFrame, raw_passages: DataFrame, final: DataFrame) -> DataFrame:
    """Per episode (raw: episode_id, text): characters before and after cleaning, and passages before and after merging."""
    n = raw_passages.groupBy("episode_id").agg(F.count("*").alias("raw_passage_count"))
    m = final.groupBy("episode_id").agg(F.count("*").alias("final_passage_count"))
    chars = raw.select("episode_id", F.length("text").cast("long").alias("raw_character_count"), F.length(T.clean("text")).cast("long").alias("character_count"))
    return chars.join(n, "episode_id", "left").join(m, "episode_id", "left").na.fill(0, ["raw_passage_count", "final_passage_count"])


def replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` passages with those of all episodes in ``fresh`` replaced."""
    return stored.join(fresh.select("episode_id").distinct(), "episode_id", "left_anti").unionByName(fresh)


def select_passages(passages: DataFrame, items: DataFrame, force: bool = False, episodes: DataFrame | None = None, up_to: int | None = None, limit: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Passages (id, episode_id, passage_index, stamped) to extract: pending ones (not stamped, without items), or all with ``force``; of some episodes, or by id; up to an index; the first ``limit`` by episode and index."""
    out = passages
    if not force:
        out = out.where("NOT stamped").join(items.select(F.col("passage_id").alias("id")).distinct(), "id", "left_anti")
    if episodes is not None:
        out = out.join(episodes.select("episode_id").distinct(), "episode_id", "left_semi")
    if ids is not None:
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    if up_to is not None:
        out = out.where(F.col("passage_index") <= up_to)
    return out if limit is None else out.orderBy("episode_id", "passage_index", "id").limit(limit)


def persist_layers(passages: DataFrame, items: DataFrame, fresh: DataFrame, model: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(passages, items) after the items of ``fresh`` (ITEM's columns) replace those of their passages; the rows get the model and time, their passages the stamp.

    ``passages`` hold extracted_at and extraction_model, ``items`` ITEM's columns, extraction_model and created_at.
    """
    done = fresh.select("passage_id").distinct()
    new = fresh.withColumn("extraction_model", F.lit(model)).withColumn("created_at", now)
    kept = items.join(done, "passage_id", "left_anti").unionByName(new.select(items.columns))
    mark = passages.join(done.withColumnRenamed("passage_id", "id").withColumn("there", F.lit(True)), "id", "left")
    stamped = mark.withColumn("extracted_at", F.when(F.col("there"), now).otherwise(F.col("extracted_at"))).withColumn("extraction_model", F.when(F.col("there"), model).otherwise(F.col("extraction_model")))
    return stamped.select(passages.columns), kept


def clear_stamps(passages: DataFrame, scope: DataFrame) -> DataFrame:
    """``passages`` without stamps, models and look-back times, whichever of them they have, in the episodes of ``scope``; vectors stay."""
    mark = passages.join(scope.select("episode_id").distinct().withColumn("there", F.lit(True)), "episode_id", "left")
    gone = {c: F.when(F.col("there").isNull(), F.col(c)) for c in ("extracted_at", "extraction_model", "lookback_completed_at") if c in passages.columns}
    return mark.withColumns(gone).select(passages.columns)


def mark_lookback(passages: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """``passages`` (with lookback_completed_at) stamped as done where ``asked`` (passage_id) has them; the others keep theirs."""
    mark = passages.join(asked.select(F.col("passage_id").alias("id")).distinct().withColumn("there", F.lit(True)), "id", "left")
    return mark.withColumn("lookback_completed_at", F.when(F.col("there"), now).otherwise(F.col("lookback_completed_at"))).select(passages.columns)


def found_episodes(episodes: DataFrame, term: str = "", page: int | str | None = 1, size: int = config.PAGE_SIZE) -> DataFrame:
    """One page of episodes (id, title, guest), newest first, whose title or guest holds ``term`` in any case. A page that is no number, or below 1, is the first; one beyond the end is the last."""
    low = F.lit(term.lower())
    rows = episodes.where(F.contains(F.lower("title"), low) | F.contains(F.lower("guest"), low))
    try:
        page = max(1, int(page))
    except (TypeError, ValueError):
        page = 1
    if page > 1:
        page = min(page, max(1, -(-rows.count() // size)))
    return rows.orderBy(F.desc("id")).offset((page - 1) * size).limit(size)


def episode_list(episodes: DataFrame, passages: DataFrame, items: DataFrame) -> DataFrame:
    """Episodes (episode_id) with their numbers of passages, layered passages (stamped), tokens and items; each table is counted before it is joined."""
    n = passages.groupBy("episode_id").agg(F.count("*").alias("passages"), F.count_if("stamped").alias("layered"), F.sum(T.token_estimate("content")).alias("tokens"))
    m = items.groupBy("episode_id").agg(F.count("*").alias("items"))
    return episodes.join(n, "episode_id", "left").join(m, "episode_id", "left").na.fill(0, ["passages", "layered", "tokens", "items"])


def unresolved_counts(items: DataFrame) -> DataFrame:
    """Per episode: its propositions and claims that are still flagged."""
    return items.where("needs_lookback AND layer <> 'phrase'").groupBy("episode_id").agg(F.count("*").alias("unresolved_count"))


def layer_status(passages: DataFrame, items: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Per episode with passages, in order of id: passages, stamped ones, a label and the unresolved items; the first ``limit``, then those with one label."""
    n = passages.groupBy("episode_id").agg(F.count("*").alias("passage_count"), F.count_if("stamped").alias("layered_passage_count"))
    label = F.when(F.col("passage_count") == F.col("layered_passage_count"), "fully_layered").when(F.col("layered_passage_count") > 0, "partial").otherwise("not_started")
    out = n.withColumn("status", label).join(unresolved_counts(items), "episode_id", "left").na.fill(0, ["unresolved_count"]).orderBy("episode_id")
    out = out if limit is None else out.limit(limit)
    return out if status is None else out.where(F.col("status") == status)


def results(hits: DataFrame, passages: DataFrame, items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Best passages of each query with their texts, matched contents and valid highlights; of equal texts (by SHA-256) the best stays.

    Repeats are dropped by digests; only then the texts are joined to what is left.

    ``hits``: (query_id, place, passage_id, layer, id, similarity); ``passages``: (id, episode_id, passage_index, content);
    ``items``: (layer, id, content, start_char, end_char). Hits whose passage is gone are left out. The columns ``keep`` of the
    passages, texts too, are made once for each passage, and come along.
    """
    matched = items.select("layer", "id", F.col("content").alias("matched_content"), "start_char", "end_char")
    hits = written(hits)  # used twice, and the search that found them is long
    wanted = hits.select(F.col("passage_id").alias("id")).distinct()
    texts = written(passages.join(wanted, "id", "left_semi").select("id", "episode_id", "passage_index", "content", *keep))
    keys = texts.select(F.col("id").alias("passage_id"), F.unhex(F.sha2("content", 256)).alias("digest"))
    first = F.row_number().over(Window.partitionBy("query_id", "digest").orderBy("place"))
    kept = hits.join(keys, "passage_id").withColumn("first", first).where("first = 1").drop("first", "digest")
    rows = kept.join(texts.withColumnRenamed("id", "passage_id"), "passage_id").join(matched, ["layer", "id"], "left")
    ok = T.valid_highlight(F.col("start_char"), F.col("end_char"), F.length("content"))
    rows = rows.withColumn("highlight_start", F.when(ok, F.col("start_char"))).withColumn("highlight_end", F.when(ok, F.col("end_char")))
    return rows.select("query_id", "place", "passage_id", "episode_id", "passage_index", "layer", "id", "similarity", "content", "matched_content", "highlight_start", "highlight_end", *keep)


def displayed(passages: DataFrame) -> DataFrame:
    """``passages`` with ``display``: the first block of a text without Markdown, cut, the second one, and the text after the first, cut."""
    cut = lambda x, most, kept, trim: F.when(F.length(x) > most, F.concat(trim(F.substring(x, 1, kept)), F.lit("…"))).otherwise(x)

    def shown(plain, blocks):
        head = blocks[0]
        rest = T.named(T.strip(F.substr(plain, F.length(head) + 1)), lambda x: cut(x, 220, 220, lambda y: y))
        return F.struct(cut(head, 280, 277, T.strip).alias("head"), F.get(blocks, F.lit(1)).alias("second"), rest.alias("rest"))

    return passages.withColumn("display", T.named(T.strip_markdown("content"), lambda p: T.named(T.display_blocks(p), lambda b: shown(p, b))))


def snippets(found: DataFrame) -> DataFrame:
    """(query_id, place, quote, context, has_highlight): the highlighted words and their sentence, else the text's first two blocks."""
    found = found if "display" in found.columns else displayed(found)
    text, start, end = F.col("content"), F.col("highlight_start").cast("int"), F.col("highlight_end").cast("int")
    matched = T.strip(F.coalesce("matched_content", F.lit("")))
    lo, hi = T.sentence_bounds(text, start, end)
    rows = found.withColumn("has_highlight", start.isNotNull() & end.isNotNull())
    rows = rows.withColumn("inner", F.when(F.col("has_highlight"), T.strip_markdown(T.highlight_parts(text, start, end)[1])))
    rows = rows.withColumn("around", F.when(F.col("has_highlight"), T.strip_markdown(F.substr(text, lo + 1, hi - lo))))
    short = F.col("display.head")
    bare = F.coalesce(F.col("inner"), F.lit("")) == ""
    sentence = F.when(~bare, F.col("around")).when(matched != "", matched).otherwise(F.coalesce("display.second", "display.rest"))
    rows = rows.withColumn("quote", F.when(bare, short).otherwise(F.col("inner"))).withColumn("sentence", sentence)
    context = F.when(F.col("has_highlight") & (matched != "") & (matched != F.col("quote")), matched).when(F.col("sentence") != F.col("quote"), F.col("sentence")).otherwise("")
    return rows.select("query_id", "place", "quote", context.alias("context"), "has_highlight")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = config.EMBED_BATCH, keep: Sequence[str] = ("id", "content")) -> DataFrame:
    """The columns ``keep`` of ``rows`` (with content) and ``embedding``, a unit vector: the answers of a model, a plug-in, asked in batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield part.assign(embedding=[np.asarray(v, float).tolist() for v in embed(part["content"].tolist())])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select(*keep).mapInPandas(run, f"{schema}, embedding array<double>").withColumn("embedding", normalised("embedding"))


def backfilled(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, now: Column, batch: int = config.EMBED_BATCH) -> DataFrame:
    """``rows`` (id, content, embedding, embedding_model, embedded_at) in which those without a vector have one, with model and time; the others never reach the model."""
    fresh = embedded(rows.where("embedding IS NULL"), embed, batch).withColumn("embedding_model", F.lit(model)).withColumn("embedded_at", now)
    return rows.where("embedding IS NOT NULL").unionByName(fresh.select(rows.columns))


def context_sections(passages: DataFrame, items: DataFrame, n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """(id, episode_id, passage_index, prior): transcripts and propositions of the last ``n`` passages before each."""
    said = items.where("layer = 'proposition'").groupBy(F.col("passage_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", "content"))).alias("said"))
    lines = F.array_join(F.transform("said.content", lambda x: F.concat(F.lit("- "), x)), "\n")
    index = F.col("passage_index").cast("string")
    text, said_ = (F.replace(F.lit(h), F.lit("{}"), index) for h in (TEXT_HEAD, SAID_HEAD))
    whole = F.concat(text, F.lit("\n"), "content", F.when(F.col("said").isNull(), "").otherwise(F.concat(F.lit("\n\n"), said_, F.lit("\n"), lines)))
    rows = passages.join(said, "id", "left").withColumn("section", whole)
    before = Window.partitionBy("episode_id").orderBy("passage_index").rowsBetween(-n, -1)
    return rows.select("id", "episode_id", "passage_index", F.array_join(F.collect_list("section").over(before), "\n\n").alias("prior"))


def _held(items: DataFrame) -> DataFrame:
    """(id, items): the items of each passage with their ids, by layer and place."""
    place = F.row_number().over(Window.partitionBy("passage_id", "layer").orderBy("p")) - 1
    plural = F.create_map(*[F.lit(x) for kv in config.LAYERS.items() for x in kv])[F.col("layer")]
    named = items.withColumn("item_id", F.concat_ws(":", "passage_id", plural, place))
    return named.groupBy(F.col("passage_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("layer", "p", "item_id", "content", "needs_lookback"))).alias("items"))


def _plain_items(held) -> list[dict]:
    return [dict(x.asDict() if hasattr(x, "asDict") else x) for x in held] if held is not None else []


def _flagged(items: list[dict]) -> list[dict]:
    return [x for x in items if x["needs_lookback"] and x["layer"] != "phrase"]


def _as_json(flags: list[dict]) -> str:
    return json.dumps([{"item_id": x["item_id"], "content": x["content"]} for x in flags], ensure_ascii=False)


def _resolve(flags: list[dict], reply: str) -> None:
    """Puts the answers of ``reply`` in place; another text than the JSON that was asked for resolves nothing."""
    try:
        said = json.loads(reply).get("resolved", [])
    except (TypeError, ValueError, AttributeError):
        said = []
    new = {r["item_id"]: r["content"] for r in said if isinstance(r, dict) and "item_id" in r and "content" in r}
    for x in flags:
        got = new.get(x["item_id"])
        if got and got != x["content"]:
            x["content"], x["needs_lookback"] = got, False


def _section(index: int, content: str, items: list[dict]) -> str:
    said = "\n".join(f"- {x['content']}" for x in items if x["layer"] == "proposition")
    return f"{TEXT_HEAD.format(index)}\n{content}" + (f"\n\n{SAID_HEAD.format(index)}\n{said}" if said else "")


def ordered_lookback(passages: DataFrame, items: DataFrame, ask: Callable[[str, str], str], n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """The items (ITEM's columns, episode_id) after each passage's flagged ones were asked for, in order of passages.

    A passage's request has the propositions of the passages before as those were resolved, so an episode's passages pass one
    task in order; it holds the sections of ``n`` passages, not the episode. ``ask`` gets the prior text and the flagged
    items as JSON and answers in JSON.
    """
    held = _held(items)
    rows = passages.select("id", "episode_id", "passage_index", "content").join(held, "id", "left").repartition("episode_id").sortWithinPartitions("episode_id", "passage_index", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        episode, sections = None, []
        for f in frames:
            out = []
            for passage, e, index, content, held_items in zip(f["id"], f["episode_id"], f["passage_index"], f["content"], f["items"]):
                if e != episode:
                    episode, sections = e, []
                mine = _plain_items(held_items)
                flags = _flagged(mine)
                if flags:
                    _resolve(flags, ask("\n\n".join(sections), _as_json(flags)))
                sections.append(_section(index, content, mine))
                sections = sections[-n:] if n else []
                out += [(x["item_id"], passage, e, x["layer"], x["content"], bool(x["needs_lookback"])) for x in mine]
            yield pd.DataFrame(out, columns=["item_id", "passage_id", "episode_id", "layer", "content", "needs_lookback"])

    return rows.mapInPandas(run, "item_id string, passage_id long, episode_id long, layer string, content string, needs_lookback boolean")


def lookback_rounds(passages: DataFrame, items: DataFrame, ask: Callable[[list[tuple[str, str]]], list[str]], n: int = config.LOOKBACK_PASSAGES, batch: int = config.EMBED_BATCH) -> DataFrame:
    """As ``ordered_lookback``, in as many rounds as the longest episode has passages.

    Round k asks for the k-th passages of all episodes at once, in batches of (prior text, flagged items as JSON), with the
    resolved sections of the ``n`` rounds before joined in; its items and sections are written before the next round, so a lost
    executor repeats a part of one round, and no task waits for the passages of one episode.
    """
    spark = passages.sparkSession
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy("passage_index", "id")) - 1
    path = scratch_dir(spark)
    rows = passages.select("id", "episode_id", "passage_index", "content").withColumn("rank", place).join(_held(items), "id", "left")
    rows.write.partitionBy("rank").parquet(path)
    ranked = spark.read.schema(rows.schema).parquet(path)
    item = "array<struct<layer: string, p: long, item_id: string, content: string, needs_lookback: boolean>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mine = [_plain_items(x) for x in f["items"]]
            flags = [_flagged(x) for x in mine]
            asked = [i for i, x in enumerate(flags) if x]
            for a in range(0, len(asked), batch):
                some = asked[a : a + batch]
                for i, reply in zip(some, ask([(f["prior"].iloc[i], _as_json(flags[i])) for i in some])):
                    _resolve(flags[i], reply)
            section = [_section(k, c, x) for k, c, x in zip(f["passage_index"], f["content"], mine)]
            yield pd.DataFrame({"id": f["id"], "episode_id": f["episode_id"], "section": section, "items": mine})

    done: list[DataFrame] = []
    last = ranked.agg(F.max("rank")).first()[0]
    for k in range(0 if last is None else last + 1):
        now = ranked.where(F.col("rank") == k)
        if before := done[max(0, k - n) : k] if n else []:
            sections = functools.reduce(DataFrame.unionByName, [d.select("episode_id", "section").withColumn("r", F.lit(i)) for i, d in enumerate(before)])
            prior = sections.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "section")))["section"], "\n\n").alias("prior"))
            now = now.join(prior, "episode_id", "left")
        else:
            now = now.withColumn("prior", F.lit(""))
        done.append(written(now.mapInPandas(run, f"id long, episode_id long, section string, items {item}")))
    if not done:
        return spark.createDataFrame([], "item_id string, passage_id long, episode_id long, layer string, content string, needs_lookback boolean")
    rows = functools.reduce(DataFrame.unionByName, done).select(F.col("id").alias("passage_id"), "episode_id", F.explode("items").alias("x"))
    return rows.select("x.item_id", "passage_id", "episode_id", "x.layer", "x.content", "x.needs_lookback")


def lookback_payloads(contexts: DataFrame, flags: DataFrame) -> DataFrame:
    """(passage_id, prior, items_json): one request for each passage with flagged items, which stand in it as JSON."""
    asked = flags.groupBy("passage_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "content")))).alias("items_json"))
    return asked.join(contexts.select(F.col("id").alias("passage_id"), "prior"), "passage_id")


def episode_export(episodes: DataFrame, passages: DataFrame, items: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(episode_id, document): an episode as JSON with its header, passages and layers in order, and the passages' vectors if given.

    Items are gathered by passage, passages by episode: one row for each episode, whose size is that of one transcript.
    """
    row = F.struct("start_char", "id", "content", "source_text")
    layers = items.groupBy(F.col("passage_id").alias("id")).agg(*[F.array_sort(F.collect_list(F.when(F.col("layer") == k, row))).alias(v) for k, v in config.LAYERS.items()])
    rows = passages.join(layers, "id", "left")
    more = []
    if vectors is not None:
        rows, more = rows.join(vectors.select("id", "embedding"), "id", "left"), ["embedding"]
    body = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("passage_index", "id", "content", *config.LAYERS.values(), *more))).alias("passages"))
    out = episodes.join(body, "episode_id", "left")
    return out.select("episode_id", F.to_json(F.struct(*[c for c in episodes.columns], F.coalesce(F.size("passages"), F.lit(0)).alias("passage_count"), "passages")).alias("document"))


def unresolved_document(episodes: DataFrame, passages: DataFrame, items: DataFrame, n: int = config.LOOKBACK_PASSAGES) -> DataFrame:
    """(episode_id, unresolved_count, items): the open items of each episode in order of layer, passage and id, with their passage and the ``n`` before."""
    contents = lambda layer: F.array_sort(F.collect_list(F.when(F.col("layer") == layer, F.struct("id", "content"))))
    blocks = passages.join(items.groupBy(F.col("passage_id").alias("id")).agg(contents("proposition").alias("props"), contents("claim").alias("claims")), "id", "left")
    block = F.struct("passage_index", "content", F.col("props.content").alias("propositions"))
    before = Window.partitionBy("episode_id").orderBy("passage_index").rowsBetween(-n, -1)
    blocks = blocks.select(F.col("id").alias("passage_id"), F.struct("passage_index", F.col("content").alias("text"), F.col("props.content").alias("propositions"), F.col("claims.content").alias("claims")).alias("passage"), F.collect_list(block).over(before).alias("prior_passages"))
    open_ = items.where("needs_lookback AND layer <> 'phrase'").select("episode_id", "passage_id", "layer", "id", "content", "source_text", "start_char", "end_char").join(blocks, "passage_id")
    rank = F.when(F.col("layer") == "proposition", 0).otherwise(1)
    entry = F.struct(rank.alias("rank"), F.col("passage.passage_index").alias("passage_index"), "id", "layer", "content", "source_text", "start_char", "end_char", "passage", "prior_passages")
    out = open_.groupBy("episode_id").agg(F.count("*").alias("unresolved_count"), F.array_sort(F.collect_list(entry)).alias("items"))
    return episodes.join(out, "episode_id")


def comparison(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """(passage_id, document): per passage the sizes of each layer in both runs and the changes, as JSON."""
    counts = lambda rows, side: rows.groupBy("passage_id").agg(*[F.count_if(F.col("layer") == k).alias(f"{side}_{v}") for k, v in config.LAYERS.items()])
    entry = F.struct("layer", "change", "key")
    diff = changes.where("change <> 'unchanged'").groupBy("passage_id").agg(F.array_sort(F.collect_list(entry)).alias("changes"))
    rows = counts(old, "old").join(counts(new, "new"), "passage_id", "full_outer").join(diff, "passage_id", "left").na.fill(0)
    sizes = F.struct(*[F.struct(F.col(f"old_{v}").alias("old"), F.col(f"new_{v}").alias("new"), (F.col(f"new_{v}") - F.col(f"old_{v}")).alias("delta")).alias(v) for v in config.LAYERS.values()])
    none = F.array().cast("array<struct<layer:string,change:string,key:string>>")
    return rows.select("passage_id", F.to_json(F.struct("passage_id", sizes.alias("counts"), F.coalesce("changes", none).alias("changes"))).alias("document"))


def comparison_report(old: DataFrame, new: DataFrame, changes: DataFrame, lookback: DataFrame, models: tuple[str, str], at: Column) -> DataFrame:
    """(episode_id, document): the comparison of two runs over an episode as JSON.

    It has the models and the time, the look-back's figures (lookback: episode_id, flagged, calls, resolved,
    still_unresolved), each layer's rows in both runs and in all, and for each passage the items of both runs and what
    changed (changes: passage_id, layer, key, change). Items are gathered by passage before passages are by episode.
    """
    entry = F.struct("layer", "p", "content", "source_text")
    side = lambda rows, name: rows.groupBy("episode_id", "passage_id").agg(F.first("passage_index").alias(f"{name}_index"), F.array_sort(F.collect_list(entry)).alias(name))
    diff = changes.where("change <> 'unchanged'").groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("layer", "change", "key"))).alias("changes"))
    rows = side(old, "old").join(side(new, "new"), ["episode_id", "passage_id"], "full_outer").join(diff, "passage_id", "left")
    none = F.array().cast("array<struct<layer:string,p:bigint,content:string,source_text:string>>")
    rows = rows.withColumns({"old": F.coalesce("old", none), "new": F.coalesce("new", none), "changes": F.coalesce("changes", F.array().cast("array<struct<layer:string,change:string,key:string>>"))})
    size = lambda name, layer: F.size(F.filter(name, lambda x: x.layer == layer)).cast("long")
    counts = {f"{n}_{v}": size(n, k) for k, v in config.LAYERS.items() for n in ("old", "new")}
    passage = F.struct(F.coalesce("old_index", "new_index").alias("passage_index"), "passage_id", "old", "new", "changes")
    by = rows.withColumns(counts).groupBy("episode_id").agg(*[F.sum(c).alias(c) for c in counts], F.array_sort(F.collect_list(passage)).alias("passages"))
    pair = lambda a, b, name: F.struct(a.alias("old"), b.alias("new"), (b - a).alias("delta")).alias(name)
    total = lambda n: sum((F.col(f"{n}_{v}") for v in config.LAYERS.values()), F.lit(0))
    totals = F.struct(*[pair(F.col(f"old_{v}"), F.col(f"new_{v}"), v) for v in config.LAYERS.values()], pair(total("old"), total("new"), "all"))
    figures = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("flagged", "calls", "resolved")], F.coalesce("still_unresolved", F.lit("")).alias("still_unresolved"))
    head = F.struct(F.lit(models[0]).alias("old_model"), F.lit(models[1]).alias("new_model"), at.cast("string").alias("at"), F.size("passages").alias("passages"))
    out = by.join(lookback, "episode_id", "left")
    return out.select("episode_id", F.to_json(F.struct("episode_id", head.alias("header"), figures.alias("lookback"), totals.alias("totals"), "passages")).alias("document"))
