"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's stream is its documents in the order of a seeded md5, once for each epoch, cut at the source's target. The
stream is dealt into blocks of whole documents by where a document starts. The tree parts the exact block quotas of all
sources among the output shards: at each node a draw without replacement says how many blocks of each source go left.
A shard then draws its quota of each source's blocks, disjoint from all others since they are cut from one seeded
permutation of the source's blocks, and shuffles the documents of its blocks locally.

Offsets in a stream are prefix sums in two steps (hash buckets, then inside a bucket), so a source with a third of all
rows is not sorted in one task. Nobody holds the tree: a draw is a function of its node, so a task finds the shard of
its blocks by walking down from the root through the nodes that it needs. The driver holds one row per source, at most
``MAX_SOURCES``: weights are a table that people write; more raise an error.

Cases: a null source is a source of its own, last in order; a null or empty text has size 0 and takes 0; repeated rows
are separate documents; sources without words have target 0; an empty table gives no rows; other columns pass ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerloom.llm.common import in_arrow, packed, slices, unused, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BLOCK_WORDS = 4096
#: Blocks of all sources together, at most; blocks grow with the corpus beyond that, since a draw takes numbers below 10 ** 9.
MOST_BLOCKS = 500_000_000
#: A shard has so many blocks, fewer if there would be less than LEAST_SHARDS.
BLOCKS_PER_SHARD = 4096
LEAST_SHARDS = 8
MAX_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


ROW = ["doc_id", "text_hash", "nth"]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row: id, hash of the text, and a number among rows that are equal in both."""
    return docs.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("source")))


def sizes(docs: DataFrame) -> DataFrame:
    """Each row with its key, its number of words and its place in the seeded order of its source."""
    place = F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), size.alias("size"), place.alias("place")))


def targets(totals: list[int], weights: tuple = WEIGHTS, most: int = MAX_EPOCHS) -> list[float]:
    """Shares of the sum by weight, none above ``most`` times its total: the excess goes to the others by weight until all fit."""
    w = [weights[i % len(weights)] for i in range(len(totals))]
    full: set[int] = set()
    while True:
        rest = sum(totals) - sum(most * totals[i] for i in full)
        left = [i for i in range(len(totals)) if i not in full]
        share = sum(w[i] for i in left)
        over = [i for i in left if w[i] * rest / share > most * totals[i]]
        if not over:
            return [float(most * totals[i]) if i in full else w[i] * rest / share for i in range(len(totals))]
        full.update(over)


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """(shards, sources) block quotas: each node draws its left half's blocks from its own without replacement."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = left_half(have, lo, hi, seed)
        nodes += [(lo, mid, left), (mid, hi, have - left)]
    return out


def left_half(have: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """How many blocks of each source the left half of a node's shards draws from the node's own, without replacement."""
    total = int(have.sum())
    draw = total * ((lo + hi) // 2 - lo) // (hi - lo)
    rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
    left = np.zeros_like(have)
    for i, n in enumerate(have.tolist()):
        total -= n
        left[i] = rng.hypergeometric(n, total, draw) if draw and n else 0
        draw -= int(left[i])
    return left


class TreeWalk:
    """Finds the shards of drawn blocks; of each source, a node's left half takes the first ones of the node's blocks. Keeps the draws of NODES nodes at most."""

    NODES = 20_000

    def __init__(self, quotas: np.ndarray, shards: int, seed: int = 0):
        self.quotas, self.shards, self.seed = quotas.astype(np.int64), shards, seed
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def shard_of(self, source: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        out = np.zeros(len(source), np.int64)
        nodes = [(0, self.shards, self.quotas, np.arange(len(source)), drawn.astype(np.int64))]
        while nodes:
            lo, hi, have, who, place = nodes.pop()
            if not len(who):
                continue
            if hi - lo == 1:
                out[who] = lo
                continue
            left = self.known.get((lo, hi))
            if left is None:
                if len(self.known) >= self.NODES:
                    self.known.clear()
                left = self.known[lo, hi] = left_half(have, lo, hi, self.seed)
            here, mid = place < left[source[who]], (lo + hi) // 2
            nodes += [(lo, mid, left, who[here], place[here]), (mid, hi, have - left, who[~here], place[~here] - left[source[who[~here]]])]
        return out


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A seeded permutation of 0..n-1 at ``i``: a Feistel network over the next power of four, walked until it is inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask, x = (np.uint64(1) << half) - np.uint64(1), i.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b, h, m = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo]
        for r in range(4):
            f = (b + seed[todo] + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def grown(block_words: int, words: int) -> int:
    """``block_words``, or as many more as keep ``words`` within MOST_BLOCKS blocks (each source may add one)."""
    return max(block_words, -(-words // MOST_BLOCKS))


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Per row of ``docs``: its key, sizes, its source's target, and its draws: epoch, block, shard, and words from the document's start."""
    spark = docs.sparkSession
    sized = written(sizes(docs))
    rows = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    totals = [r.total for r in rows]
    want = targets(totals) if sum(totals) else [0.0] * len(rows)
    words = np.array([min(round(t), MAX_EPOCHS * s) for t, s in zip(want, totals)], np.int64)
    block_words = grown(block_words, int(words.sum()))
    quota = -(-words // block_words)
    shards = max(least_shards, -(-int(quota.sum()) // blocks_per_shard))
    mix = spark.sparkContext.broadcast((words, quota, shards))
    known = spark.createDataFrame([(i, r.source, r.total, float(want[i])) for i, r in enumerate(rows)], "k int, named string, source_size long, target double")
    digits = 1 + max(0, int(np.ceil(np.log2(max(1, max([r.n for r in rows], default=1) / 50_000)) / 4)))
    placed = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("named"))).drop("named", "source").withColumn("bucket", F.substring("place", 1, digits))
    before = lambda *by: Window.partitionBy("k", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("k", "bucket").agg(F.sum("size").alias("held"))
    buckets = buckets.select("k", "bucket", F.coalesce(F.sum("held").over(before(["bucket"])), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(before("bucket", ["place", *ROW])), F.lit(0))
    located = placed.withColumn("within", within).join(buckets, ["k", "bucket"]).withColumn("offset", F.col("base") + F.col("within"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, quota, shards = mix.value
        tree = TreeWalk(quota, shards)
        for x in batches:
            k, size = x.k.to_numpy(), x["size"].to_numpy()
            draws: list[list] = [[] for _ in range(len(x))]
            for e in range(MAX_EPOCHS):
                start = x.offset.to_numpy() + e * x.source_size.to_numpy()
                take = np.clip(words[k] - start, 0, size)
                i = np.flatnonzero(take > 0)
                block = start[i] // block_words
                drawn = permuted(block, quota[k[i]], (k[i] + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
                shard = tree.shard_of(k[i], drawn)
                for j, *d in zip(i.tolist(), block.tolist(), shard.tolist(), take[i].tolist()):
                    draws[j].append({"epoch": e, "block": d[0], "shard": d[1], "n_words": d[2]})
            yield x[[*ROW, "k", "size", "source_size", "target", "place"]].assign(draws=draws)

    return located.mapInPandas(draw, "doc_id long, text_hash long, nth int, k int, size long, source_size long, target double, place string, draws array<struct<epoch: int, block: long, shard: long, n_words: long>>")


def taken(docs: DataFrame) -> DataFrame:
    """Per document: its words, its source's words and target, and the words that the shards draw of it, also shard by shard."""
    total = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.n_words)
    shards = F.transform("draws", lambda d: F.struct(d.shard.alias("shard"), d.n_words.alias("n_words")))
    return plan(docs).select("doc_id", "size", "source_size", "target", total.alias("taken"), shards.alias("shards"))


def shard_words(docs: DataFrame, **sizes_: int) -> DataFrame:
    """What the tree dealt out: per shard and source, the blocks that hold documents, and their words."""
    draws = plan(docs, **sizes_).select("k", F.explode("draws").alias("d"))
    return draws.groupBy(F.col("d.shard").alias("shard"), F.col("k").alias("source_number")).agg(F.countDistinct("d.block").alias("n_blocks"), F.sum("d.n_words").alias("n_words"))


def _drawn(docs: DataFrame, **sizes_: int) -> DataFrame:
    """One row for each draw: the columns of ``docs`` with the text packed as ``body``, the number of words to keep if it is cut, ``mix_shard`` and ``mix_order``."""
    d = plan(docs, **sizes_).select(*ROW, "k", "size", "place", F.explode("draws").alias("d"))
    order = F.md5(F.concat_ws("|", "d.shard", "k", "d.block", "d.epoch", "place").cast("binary"))
    cut = F.when(F.col("d.n_words") < F.col("size"), F.col("d.n_words"))
    d = d.select(F.coalesce("doc_id", F.lit(0)).alias("drawn_id"), F.col("doc_id").isNull().alias("drawn_null"), F.col("text_hash").alias("drawn_hash"), F.col("nth").alias("drawn_nth"), F.col("d.shard").alias("mix_shard"), order.alias("mix_order"), cut.cast("int").alias("drawn_cut"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"])
    rows = docs.select(others.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), F.col("text").isNull().alias("no_text"), "text")
    rows = numbered(packed(rows))  # the texts are shuffled here, and once more where shards are written
    return rows.join(d, (F.coalesce("doc_id", F.lit(0)) == F.col("drawn_id")) & (F.col("doc_id").isNull() == F.col("drawn_null")) & (F.col("text_hash") == F.col("drawn_hash")) & (F.col("nth") == F.col("drawn_nth"))).select("row", "no_text", "body", "drawn_cut", "mix_shard", "mix_order")


def _unpacked(drawn: DataFrame, columns: list[str], whole: bool) -> DataFrame:
    """``drawn`` with its ``columns``, texts among them, in the same order of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "body"):
                empty = part.column("no_text").to_pylist()
                said = pa.array([None if none else t.decode() for none, t in zip(empty, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "drawn_cut", "mix_shard", "mix_order")), said], ["row", "drawn_cut", "mix_shard", "mix_order", "text"])

    schema = T.StructType([*(drawn.schema[c] for c in ("row", "drawn_cut", "mix_shard", "mix_order")), T.StructField("text", T.StringType())])
    out, text = drawn.transform(in_arrow, run, schema), F.col("text")
    if not whole:
        words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
        text = F.when(F.col("drawn_cut").isNull(), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.coalesce("drawn_cut", F.lit(1))), ""))
    kept = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in columns if c.lower() not in ("mix_shard", "mix_order")]
    return out.select(*kept, "mix_shard", "mix_order")


def mix(docs: DataFrame, whole: bool = False, **sizes_: int) -> DataFrame:
    """The mixed documents with all their columns and ``mix_shard``, ``mix_order`` (in place of columns of these names): one row for each draw, shuffled inside its shard.

    A source's stream ends at its target to the word, so its last document may be cut there; with ``whole`` it is kept
    whole. ``sizes_`` go to ``plan``.
    """
    return _unpacked(_drawn(docs, **sizes_), docs.columns, whole)


def mixed_shards(docs: DataFrame, **sizes_: int) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a shard's rows stand in tasks of their own, a large shard's in several, in the order of its local shuffle."""
    drawn = _drawn(docs, **sizes_).repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    names = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
    out = _unpacked(drawn, docs.columns, False)
    return out.select(names) if len(names) == len(docs.columns) else _with_own(drawn, docs)


def _with_own(drawn: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``_unpacked``, with columns of ``docs`` that are called like the mix's."""
    taken = [c for c in docs.columns if c.lower() in ("mix_shard", "mix_order")]
    safe = {c: unused(f"own_{c}", [*docs.columns, *taken]) for c in taken}
    fields = F.struct(*[F.col(f"row.`{c}`").alias(safe.get(c, c)) for c in docs.columns if c.lower() != "text"])
    out = _unpacked(drawn.withColumn("row", fields), [safe.get(c, c) for c in docs.columns], False)
    return out.select(*[F.col(f"`{safe.get(c, c)}`").alias(c) for c in docs.columns])
