"""Hard negatives: rows of other labels whose scores lie in a band below that of an anchor's best rows of its own label.

Vectors are quantised to integers, and a row's score with an anchor is their inner product. Products are bit-sliced: with
``u`` a row shifted to be positive, the planes of ``u`` are added most significant first, so after each the score is known
to an interval whose width halves. A pair is dropped as soon as its interval cannot reach the anchor's list any more: it
ends below the list's last entry or the band, or starts above the band. The leading planes, after which intervals are
first narrow enough to drop anything, are one matrix product of a block of rows with a block of anchors; the other planes
follow plane by plane, for blocks while many pairs are left and then for the pairs that are.

The anchors stand in blocks of at most ANCHOR_BYTES, which are broadcast one at a time; every block meets all rows, which are
read where they lie and never shuffled. A task keeps the best rows of each list only, and sends those. Two passes: the
positives of a block's anchors give the bands, then the negatives are searched.

Cases: rows with a null id, label or vector, or a component that is null or not finite, take no part. A vector that is
shorter than another has zeros for what it lacks. Rows that repeat an id each count for themselves, and none is a positive
of an anchor with its id; an anchor that stands in several equal rows is one anchor, and anchors that share an id but not
the vector or label are told apart by ``anchor_number``. Ties go to smaller ids. An empty table gives no rows; other
columns are ignored. Scores must fit 64 bits: components so large that one might not are an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom.llm.common import in_arrow, ranges, written

SCALE = 256
#: Bytes of a block of anchors, as 64-bit integers.
ANCHOR_BYTES = 8 << 20
#: Rows and anchors that one matrix product joins.
ROWS, ANCHORS = 2048, 1024
#: The leading planes, which one product adds; the others follow one by one.
LEADING = 5
#: Pairs whose planes are gathered at once.
PAIRS = 1 << 16
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: pa.Array, width: int | None = None, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(x, valid): floor(scale * component) of each vector, to ``width`` components, and whether it has no null or non-finite one."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    good = np.isfinite(flat)
    valid = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~good], minlength=len(size)) == 0)
    width = int(size[valid].max(initial=0)) if width is None else width
    column = ranges(np.zeros(len(size), np.int64), size)
    use = valid[row] & (column < width)
    value = np.floor(scale * flat[use])
    if len(value) and np.abs(value).max() >= 2.0**61:
        raise OverflowError("components beyond 61 bits have no score of 64 bits")
    x = np.zeros((len(size), width), np.int64)
    x[row[use], column[use]] = value.astype(np.int64)
    return x, valid


class Lists:
    """The best ``k`` rows of each list, by falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _LOW), np.full((n, k), _HIGH)

    def last(self) -> np.ndarray:
        """Of each list the score of its last entry; the smallest number if it is not full."""
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        better = (score > self.score[of, -1]) | ((score == self.score[of, -1]) & (row_id < self.id[of, -1]))
        of, score, row_id = of[better], score[better], row_id[better]
        if not len(of):
            return
        touched = np.unique(of)
        of = np.concatenate([np.repeat(touched, self.k), of])
        score = np.concatenate([self.score[touched].ravel(), score])
        row_id = np.concatenate([self.id[touched].ravel(), row_id])
        order = np.lexsort((row_id, ~score, of))  # ~ turns the order round without an overflow
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        self.score[of[keep], place[keep]] = score[order][keep]
        self.id[of[keep], place[keep]] = row_id[order][keep]


class Anchors:
    """A block of anchors in order of label: ids, labels, integer vectors, and of each list its band [low, high]."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.number, self.ids, self.labels, self.x, self.low, self.high = number, ids, labels, x, low, high
        self.most = int(np.abs(x).max(initial=0))

    def kind(self, most: int) -> type:
        """The narrowest type that holds all scores with rows of components up to ``most``."""
        bound = self.x.shape[1] * max(1, self.most) * 2 * max(1, most)
        if bound >= 1 << 62:
            raise OverflowError("a score might not fit 64 bits")
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _sliced(a: Anchors, at: slice, lists: Lists, x: np.ndarray, row_id: np.ndarray, eligible: np.ndarray | None) -> None:
    """Adds to ``lists`` what the rows ``x`` give to the anchors ``at``; pairs that are not ``eligible`` are left out."""
    most = int(np.abs(x).max(initial=0))
    kind, top = a.kind(most), most.bit_length()
    u, vectors = x + (1 << top), a.x[at].astype(kind)
    q = a.low.shape[1]
    first = at.start * q
    slots = slice(first, first + len(vectors) * q)
    p = max(0, top + 1 - LEADING)
    known = (u >> p).astype(kind) @ vectors.T * kind(1 << p) - kind(1 << top) * vectors.sum(1)
    ones, norm = np.abs(vectors).sum(1, dtype=np.float64), np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    total = vectors.sum(1, dtype=np.float64)

    def interval() -> tuple[np.ndarray, np.ndarray]:
        """What the planes below p can add to each anchor's scores, at least and at most."""
        middle = ((1 << p) - 1) / 2
        rest = np.sqrt((((u & ((1 << p) - 1)) - middle) ** 2).sum(1)).max(initial=0)
        half = np.minimum(middle * ones, rest * norm)
        return np.floor(middle * total - half) - 1, np.ceil(middle * total + half) + 1

    def bands() -> tuple[np.ndarray, np.ndarray]:
        last = lists.last()[slots].reshape(-1, q)
        low, high = np.maximum(a.low[at], last).astype(np.float64), a.high[at].astype(np.float64)
        if kind is np.int64:  # what a double rounds away must not drop a pair
            low, high = low - np.abs(low) * 2.0**-48, high + np.abs(high) * 2.0**-48
        return low, high

    below, above = interval()
    low, high = bands()
    fresh = lists.last()[slots].reshape(-1, q) == _LOW
    if fresh.any() and len(x) >= lists.k:
        # the k-th best score that is sure to be in the band bounds a list that has nothing yet
        for r in np.flatnonzero(fresh.any(0)):
            sure = np.where((known + below >= low[:, r]) & (known + above <= high[:, r]), known, -np.inf)
            if eligible is not None:
                sure[~eligible] = -np.inf
            low[:, r] = np.maximum(low[:, r], np.partition(sure, -lists.k, axis=0)[-lists.k] + below)
    while True:
        mask = (known >= low.min(1) - above) & (known <= high.max(1) - below)
        if eligible is not None:
            mask &= eligible
        if p == 0 or np.count_nonzero(mask) * 16 <= mask.size:
            break
        p -= 1
        known += ((u >> p) & 1).astype(kind) @ vectors.T * kind(1 << p)
        below, above = interval()
    i, j = np.nonzero(mask)
    score = known[i, j].astype(np.int64)
    while True:
        wanted = np.zeros(len(i), bool)
        for r in range(q):
            wanted |= (score + above[j] >= low[j, r]) & (score + below[j] <= high[j, r])
        i, j, score = i[wanted], j[wanted], score[wanted]
        if p == 0:
            break
        p -= 1
        plane = ((u >> p) & 1).astype(bool)
        for b in range(0, len(i), PAIRS):
            score[b : b + PAIRS] += np.where(plane[i[b : b + PAIRS]], a.x[at][j[b : b + PAIRS]], 0).sum(1) << p
        below, above = interval()
    for r in range(q):
        inside = (score >= a.low[at][j, r]) & (score <= a.high[at][j, r])
        lists.add(first + j[inside] * q + r, score[inside], row_id[i[inside]])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return ((lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo)


def _same_label(a: Anchors, lists: Lists, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    order = np.lexsort((ids, labels))
    x, ids, labels = x[order], ids[order], labels[order]
    for lo, hi in _runs(a.labels):
        b, e = np.searchsorted(labels, a.labels[lo], "left"), np.searchsorted(labels, a.labels[lo], "right")
        for at in range(lo, hi, ANCHORS) if e > b else ():
            part = slice(at, min(hi, at + ANCHORS))
            other = ids[b:e, None] != a.ids[None, part]
            _sliced(a, part, lists, x[b:e], ids[b:e], None if other.all() else other)


def _other_label(a: Anchors, lists: Lists, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    for at in range(0, len(a.ids), ANCHORS):
        part = slice(at, at + ANCHORS)
        _sliced(a, part, lists, x, ids, labels[:, None] != a.labels[None, part])


def _search(rows: DataFrame, anchors: Anchors, k: int, scale: int, same: bool) -> DataFrame:
    """(list, row_id, score, rank): the best ``k`` rows of each list; list i * q + r is the r-th band of anchor i."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)  # at most ANCHOR_BYTES of vectors
    width = anchors.x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        lists = Lists(a.low.size, k)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                x, valid = quantised(part.column("embedding"), width, scale)
                ids, labels = part.column("vec_id").to_numpy()[valid], part.column("label").to_numpy()[valid]
                if len(ids):
                    (_same_label if same else _other_label)(a, lists, x[valid], ids, labels)
        of, place = np.nonzero(lists.score != _LOW)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(lists.id[of, place]), pa.array(lists.score[of, place])], ["list", "row_id", "score"])

    found = rows.transform(in_arrow, run, "list long, row_id long, score long")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(rows: DataFrame, chosen: DataFrame, positives: int, negatives: int, low: int, high: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    t = chosen.toArrow().combine_chunks()
    x, valid = quantised(t.column("embedding").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), None, scale)
    ids, labels = t.column("vec_id").to_numpy()[valid], t.column("label").to_numpy()[valid]
    x = x[valid]
    order = np.lexsort((*x.T[::-1], ids, labels)) if x.shape[1] else np.lexsort((ids, labels))
    ids, labels, x = ids[order], labels[order], x[order]
    whole = np.full((len(ids), 1), _LOW), np.full((len(ids), 1), _HIGH)
    best = _search(rows, Anchors(np.arange(len(ids)), ids, labels, x, *whole), positives, scale, True).toPandas()  # at most ``positives`` rows an anchor
    of, place, score = best["list"].to_numpy(np.int64), best["rank"].to_numpy(np.int64) - 1, best["score"].to_numpy(np.int64)
    bands = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
    # low * p <= 100 * s <= high * p, as whole numbers; a list for each score, which equal positives share
    value = np.full((len(ids), positives), _LOW)
    value[of, place] = score
    same = np.concatenate([np.zeros((len(ids), 1), bool), value[:, 1:] == value[:, :-1]], 1)
    shared = np.maximum.accumulate(np.where(same, 0, np.arange(positives)), axis=1)
    for i, r, s in zip(of.tolist(), place.tolist(), score.tolist()):
        if not same[i, r]:
            bands[0][i, r], bands[1][i, r] = -(-low * s // 100), high * s // 100
    found = _search(rows, Anchors(np.arange(len(ids)), ids, labels, x, *bands), negatives, scale, False)
    columns = {"list": of * positives + shared[of, place], "anchor_id": ids[of], "positive_id": best["row_id"].to_numpy(np.int64), "positive_score": score, "positive_rank": place + 1, "anchor_number": of}
    pairs = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))
    return pairs.join(found, "list").select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank", "anchor_number")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_number).

    Anchors are the rows of ``vectors`` (vec_id, label, embedding) whose id is divisible by ``every``; the score of a
    negative lies between ``low`` and ``high`` percent of its positive's.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    chosen = rows.where(F.col("vec_id") % every == 0).dropDuplicates()
    size = chosen.agg(F.sum(F.size("embedding").cast("long") * 8 + 32)).first()[0] or 0
    blocks = max(1, -(-size // anchor_bytes))
    if blocks == 1:
        return _block(rows, chosen, positives, negatives, low, high, scale)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = [written(_block(rows, chosen.where(part == b), positives, negatives, low, high, scale).withColumn("anchor_number", F.col("anchor_number") * blocks + b)) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)
