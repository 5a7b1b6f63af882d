"""Admission of transcripts: header rules, one episode per content hash, back-filled hashes, and the fold of neighbours."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions import text as T
from layerloom.scratch import written


def checked(files: DataFrame, *keep: str) -> DataFrame:
    """Files (file_id, name, raw) with title, guest, content_hash and the first ``rule`` of the header that they fail."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = files.select("file_id", *keep, "name", T.header("raw").alias("h"))
    rows = rows.select("file_id", *keep, "name", "h.title", "h.guest", "h.has_header", T.content_hash(T.clean("h.body")).alias("content_hash"))
    rule = F.when(~F.lower("name").endswith(".txt"), "not a text file").when(~F.col("has_header"), "no header").when(blank("title"), "no title").when(blank("guest"), "no guest")
    cut = lambda c: F.substring(c, 1, 255).alias(c)
    return rows.select("file_id", *keep, "name", cut("title"), cut("guest"), "content_hash", rule.alias("rule"))


def admit(files: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Files (file_id, name, raw) with ``reject_reason`` (null: admitted) and ``duplicate_of``; the first failing rule counts.

    Copies are found by the smallest admissible id of each hash, which is aggregated before it is joined. ``library``
    (id, content_hash) holds the episodes that are stored already. Texts are read once: headers and hashes are written before
    they are used twice.
    """
    rows = written(checked(files))
    held = rows.where("rule IS NULL").groupBy("content_hash").agg(F.min("file_id").alias("first"))
    if library is not None:
        stored = library.groupBy("content_hash").agg(F.min("id").alias("stored"))
        held = held.join(stored, "content_hash", "left")
    else:
        held = held.withColumn("stored", F.lit(None).cast("long"))
    out = rows.join(held, "content_hash", "left")
    of = F.when(F.col("rule").isNull(), F.coalesce("stored", F.when(F.col("first") < F.col("file_id"), F.col("first"))))
    reason = F.coalesce("rule", F.when(of.isNotNull(), "duplicate"))
    return out.select("file_id", "title", "guest", "content_hash", reason.alias("reject_reason"), of.alias("duplicate_of"))


def admission_counts(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("files"))


def backfill_hashes(episodes: DataFrame) -> DataFrame:
    """For each episode (id, content_hash, text) without a hash: ``updated`` with it, or ``skipped`` where another holds it."""
    todo = episodes.where("content_hash IS NULL").select("id", T.content_hash(T.clean("text")).alias("hash"))
    held = episodes.where("content_hash IS NOT NULL").select(F.col("content_hash").alias("hash")).distinct()
    free = todo.groupBy("hash").agg(F.min("id").alias("first")).join(held, "hash", "left_anti")
    mine = F.coalesce(F.col("first") == F.col("id"), F.lit(False))
    return todo.join(free, "hash", "left").select("id", F.when(mine, F.col("hash")).alias("content_hash"), F.when(mine, "updated").otherwise("skipped").alias("action"))


#: Positions of an episode that are folded together.
SEGMENT = 512
#: Passages at the head of a segment whose vectors the first replay has.
HEAD = 32


class _Fold:
    """The group so far: its vector, which is the normalised mean, and its tokens."""

    def __init__(self, threshold: float, cap: int, vector: np.ndarray | None = None, tokens: int = 0):
        self.threshold, self.cap, self.vector, self.tokens = threshold, cap, vector, tokens

    def add(self, x: np.ndarray, tokens: int) -> tuple[bool, float | None]:
        """Whether the passage begins a group, and its likeness to the group before."""
        like = None if self.vector is None else float(self.vector @ x)
        if like is None or not like > self.threshold or self.tokens + tokens > self.cap:
            self.vector, self.tokens = x, tokens
            return True, like
        mean = (self.vector + x) / 2
        size = np.sqrt(mean @ mean)
        self.vector, self.tokens = mean / size if size else mean, self.tokens + tokens
        return False, like


_FOLDED = "episode_id long, segment long, k long, position long, tokens long, begins boolean, likeness double, head array<double>, last array<double>, last_tokens long"
_REPLAYED = "episode_id long, segment long, position long, begins boolean, likeness double, agreed boolean, last array<double>, last_tokens long"


def _folded(rows: DataFrame, threshold: float, cap: int, head: int) -> DataFrame:
    """Every segment folded as if a group began with it; its first passages keep their vectors, its last row has the group it ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold, k, late = None, None, 0, None
        for b in batches:
            out = []
            for e, g, position, tokens, v in zip(b["episode_id"], b["segment"], b["position"], b["tokens"], b["embedding"]):
                if (e, g) != key:
                    if late:
                        out.append((*late[:8], fold.vector, fold.tokens))
                    key, fold, k, late = (e, g), _Fold(threshold, cap), 0, None
                if late:
                    out.append((*late, None, None))
                x = np.asarray(v, np.float64)
                begins, like = fold.add(x, tokens)
                late = (e, g, k, position, tokens, begins, like, x if k < head else None)
                k += 1
            yield _frame(out, _FOLDED)
        if late:
            yield _frame([(*late, fold.vector, fold.tokens)], _FOLDED)

    return rows.repartition("episode_id", "segment").sortWithinPartitions("episode_id", "segment", "position").mapInPandas(run, _FOLDED)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("last_tokens",)} | {"likeness": "float64"})


def _replayed(rows: DataFrame, before: DataFrame, threshold: float, cap: int) -> DataFrame:
    """Segments (rows: what they have as ``begins``, with vectors) folded on from the group ``before`` them, until a group begins where it did; the last row of each says whether one did, and else the group it ends in."""
    none = F.lit(None)
    heads = before.select("episode_id", "segment", none.cast("long").alias("position"), F.col("last_tokens").alias("tokens"), none.cast("boolean").alias("begins"), F.col("last").alias("embedding"))
    both = rows.select(heads.columns).unionByName(heads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold, agreed = None, None, False
        for b in batches:
            out = []
            for e, g, position, tokens, begins, v in zip(b["episode_id"], b["segment"], b["position"], b["tokens"], b["begins"], b["embedding"]):
                x = np.asarray(v, np.float64)
                if pd.isna(position):  # a group's vector comes before the segment
                    if key is not None and not agreed:
                        out.append((*key, None, None, None, False, fold.vector, fold.tokens))
                    key, fold, agreed = (e, g), _Fold(threshold, cap, x, tokens), False
                elif not agreed:
                    new, like = fold.add(x, tokens)
                    out.append((e, g, position, new, like, None, None, None))
                    if new and begins:
                        agreed = True
                        out.append((e, g, None, None, None, True, None, None))
            yield _replay_frame(out)
        if key is not None and not agreed:
            yield _replay_frame([(*key, None, None, None, False, fold.vector, fold.tokens)])

    return both.repartition("episode_id", "segment").sortWithinPartitions("episode_id", "segment", F.asc_nulls_first("position")).mapInPandas(run, _REPLAYED)


def _replay_frame(rows: list[tuple]) -> pd.DataFrame:
    return _frame(rows, _REPLAYED).astype({"position": "Int64", "begins": "boolean", "agreed": "boolean"})


def merge_neighbours(passages: DataFrame, threshold: float = config.MERGE_THRESHOLD, cap: int = config.MERGE_MAX_TOKENS, segment: int = SEGMENT, head: int = HEAD) -> DataFrame:
    """Passages (episode_id, position, tokens, embedding) with the group that each belongs to, and its likeness to the group so far.

    A passage joins the group before it if the dot product with the group's vector exceeds ``threshold`` and the tokens fit
    ``cap``; the vector is then the normalised mean. Each passage depends on the one before, but a group that begins forgets
    what was before it. So every segment of ``segment`` positions is folded at once as if a group began with it, and then
    again from the group in which the segment before it ends, until a group begins where one did the first time; from there
    on the first fold was right. That mostly happens within the first ``head`` passages. Segments where it does not are
    replayed whole, and the next one once more after them, so an episode is spread over tasks, and the rounds end.
    """
    rows = passages.select(F.col("episode_id").cast("long").alias("episode_id"), F.col("position").cast("long").alias("position"), F.col("tokens").cast("long").alias("tokens"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("segment", F.floor(F.col("position") / segment))
    folded = written(_folded(rows, threshold, cap, head))
    ends = folded.where("last IS NOT NULL").select("episode_id", "segment", "last", "last_tokens", F.lead("segment").over(Window.partitionBy("episode_id").orderBy("segment")).alias("next"))
    after = lambda e: e.where("next IS NOT NULL").select("episode_id", F.col("next").alias("segment"), "last", "last_tokens")
    # the heads first: with the whole segment where it is no longer than that
    size = folded.groupBy("episode_id", "segment").agg(F.max("k").alias("most"))
    before = after(ends)
    first = folded.where(F.col("k") < head).select("episode_id", "segment", "position", "tokens", "begins", F.col("head").alias("embedding")).join(before.select("episode_id", "segment"), ["episode_id", "segment"], "left_semi")
    replays = [written(_replayed(first, before, threshold, cap).withColumn("round", F.lit(0)))]
    # what did not agree within its head is replayed whole, from the same group
    open_ = replays[0].where("NOT agreed").select("episode_id", "segment").join(size, ["episode_id", "segment"])
    again = before.join(open_.where(F.col("most") >= head), ["episode_id", "segment"], "left_semi")
    moved = replays[0].where("NOT agreed").select("episode_id", "segment", "last", "last_tokens").join(open_.where(F.col("most") < head), ["episode_id", "segment"], "left_semi")
    following = ends.select("episode_id", "segment", "next")
    begins = folded.select("episode_id", "position", "begins")
    ever = moved.select("episode_id", "segment")
    while True:
        again = written(_latest(again, after(moved.join(following, ["episode_id", "segment"]))))
        if again.isEmpty():
            break
        whole = rows.join(again.select("episode_id", "segment"), ["episode_id", "segment"], "left_semi").join(begins, ["episode_id", "position"])
        replays.append(written(_replayed(whole, again, threshold, cap).withColumn("round", F.lit(len(replays)))))
        moved = replays[-1].where("NOT agreed").select("episode_id", "segment", "last", "last_tokens")
        # one that ended elsewhere before, and agrees now, gives the next one its first end back
        back = replays[-1].where("agreed").select("episode_id", "segment").join(ever, ["episode_id", "segment"], "left_semi")
        ever = ever.unionByName(moved.select("episode_id", "segment")).distinct()
        moved = moved.unionByName(ends.select(moved.columns).join(back, ["episode_id", "segment"], "left_semi"))
        again = again.limit(0)
    said = functools.reduce(DataFrame.unionByName, replays).where("position IS NOT NULL OR agreed IS NOT NULL")
    last = said.groupBy("episode_id", "segment").agg(F.max("round").alias("round"))
    right = said.join(last, ["episode_id", "segment", "round"]).where("position IS NOT NULL").select("episode_id", "position", F.col("begins").alias("begins_"), F.col("likeness").alias("likeness_"), F.lit(True).alias("there"))
    out = folded.select("episode_id", "segment", "position", "tokens", "begins", "likeness").join(right, ["episode_id", "position"], "left")
    pick = lambda c: F.when(F.col("there"), F.col(f"{c}_")).otherwise(F.col(c)).alias(c)
    out = out.select("episode_id", "segment", "position", "tokens", pick("begins"), pick("likeness"))
    # groups are numbered by counts of the segments before and within the segment
    n = out.groupBy("episode_id", "segment").agg(F.count_if("begins").alias("n"))
    ahead = n.select("episode_id", "segment", F.coalesce(F.sum("n").over(Window.partitionBy("episode_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("episode_id", "segment").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("inside", inside).join(ahead, ["episode_id", "segment"])
    return out.select("episode_id", "position", "tokens", (F.col("ahead") + F.col("inside") - 1).alias("group_index"), "likeness")


def _latest(whole: DataFrame, moved: DataFrame) -> DataFrame:
    """Groups before segments: those of ``moved`` in place of those of ``whole``."""
    return moved.unionByName(whole.select(moved.columns).join(moved.select("episode_id", "segment"), ["episode_id", "segment"], "left_anti"))


def merge_report(merged: DataFrame) -> DataFrame:
    """Per episode: passages before and after merging, and merges."""
    out = merged.groupBy("episode_id").agg(F.count("*").alias("raw_passages"), (F.max("group_index") + 1).alias("final_passages"))
    return out.withColumn("merges", F.col("raw_passages") - F.col("final_passages"))
