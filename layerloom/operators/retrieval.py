"""Nearest items of several layers for many queries, and de-duplication by similarity. Vectors are never shuffled for retrieval."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions.vectors import cosine
from layerloom.scratch import written

#: Bytes of query vectors that are broadcast at once.
QUERY_BLOCK = 32 << 20
#: Smaller blocks grow with the queries, so that there are no more than so many: every block is a pass over all items.
MOST_BLOCKS = 4
#: Rows and queries that one product joins.
TILE = 1024
#: Stands for a null passage inside a task.
NO_PASSAGE = -(1 << 63)
LAYER_RANK = {"chunk": 0, "proposition": 1, "claim": 2, "phrase": 3}


class Nearest:
    """The nearest ``k`` rows of each list that a task has met: by distance, then by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.distance, self.id, self.passage = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)

    def bound(self) -> np.ndarray:
        """Of each list the distance of its last row; infinite if it is not full."""
        return self.distance[:, -1]

    def add(self, of: np.ndarray, distance: np.ndarray, ids: np.ndarray, passages: np.ndarray) -> None:
        if not len(of):
            return
        touched = np.unique(of)
        of = np.concatenate([np.repeat(touched, self.k), of])
        distance, ids, passages = (np.concatenate([mine[touched].ravel(), new]) for mine, new in ((self.distance, distance), (self.id, ids), (self.passage, passages)))
        order = np.lexsort((ids, distance, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        of, place, order = of[keep], place[keep], order[keep]
        self.distance[of, place], self.id[of, place], self.passage[of, place] = distance[order], ids[order], passages[order]


def unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the rows without null or non-finite ones, and their unit vectors in double (zeros stay zeros)."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.maximum(size, 0))
    out = {}
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == width)
        x = flat[(ends[rows] - width)[:, None] + np.arange(width)]
        good = np.isfinite(x).all(1)
        rows, x = rows[good], x[good]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        out[width] = rows, x / np.where(norm == 0, 1, norm)[:, None]
    return out


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The number of blocks, and ``queries`` (query_id, embedding) in blocks of about ``block_bytes``; the driver holds one at a time.

    Where that were more than ``MOST_BLOCKS``, blocks are larger, up to ``QUERY_BLOCK`` bytes (or ``block_bytes``, if that is more).
    """
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.agg(F.sum(F.size("embedding").cast("long") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // max(block_bytes, min(QUERY_BLOCK, -(-size // MOST_BLOCKS)))))
    for b in range(blocks):
        yield blocks, (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()


def layer_hits(items: DataFrame, queries: DataFrame, threshold: float = config.RETRIEVAL_THRESHOLD, phrase_threshold: float = config.PHRASE_THRESHOLD, limit: int = config.LAYER_LIMIT, block_bytes: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, layer, id, passage_id, distance): the nearest items of each layer within its threshold. Every item meets every query.

    The queries are broadcast in blocks of about ``block_bytes`` (``query_blocks``). A task multiplies its items with a block, in tiles, and
    keeps the nearest ``limit`` of each query and layer; only those are shuffled. With more than one block, a block's hits
    are written before the next one starts. Distances are ordered to twelve digits, so that equal vectors stand in order
    of their ids; items whose vector is null, has a null or non-finite component, or another length than a query's, are no
    hits of it.
    """
    rows = items.select("layer", F.col("id").cast("long").alias("id"), F.col("passage_id").cast("long").alias("passage_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id IS NOT NULL")
    found = []
    for blocks, block in query_blocks(queries, block_bytes):
        hits = _block_hits(rows, block, threshold, phrase_threshold, limit)
        found.append(hits if blocks == 1 else written(hits))
    return functools.reduce(DataFrame.unionByName, found)


def _block_hits(rows: DataFrame, block: pa.Table, threshold: float, phrase_threshold: float, limit: int) -> DataFrame:
    asked = unit_rows(block.column("embedding").combine_chunks() if block.num_rows else pa.array([], pa.list_(pa.float64())))
    held = rows.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), asked))  # about QUERY_BLOCK bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = held.value
        nearest: dict[str, Nearest] = {}
        for batch in batches:
            ids, layers = batch.column("id").to_numpy(), batch.column("layer").to_pylist()
            passages = pc.fill_null(batch.column("passage_id"), NO_PASSAGE).to_numpy()
            names = {name: np.array([x == name for x in layers]) for name in set(layers)}
            for width, (at, x) in unit_rows(batch.column("embedding")).items():
                for name, mine in names.items() if width in queries else ():
                    some, of = x[mine[at]], at[mine[at]]
                    lists = nearest.setdefault(name, Nearest(len(query_ids), limit))
                    _meet(lists, some, ids[of], passages[of], *queries[width], 1 - (phrase_threshold if name == "phrase" else threshold))
        for name, lists in nearest.items():
            q, place = np.nonzero(np.isfinite(lists.distance))
            passage = lists.passage[q, place]
            columns = [pa.array(query_ids[q]), pa.array([name] * len(q), pa.string()), pa.array(lists.id[q, place]), pa.array(passage, mask=passage == NO_PASSAGE), pa.array(lists.distance[q, place])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "layer", "id", "passage_id", "distance"])

    near = rows.mapInArrow(run, "query_id long, layer string, id long, passage_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy("distance", "id"))
    return near.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def _meet(lists: Nearest, x: np.ndarray, ids: np.ndarray, passages: np.ndarray, of: np.ndarray, queries: np.ndarray, most: float) -> None:
    """The rows ``x`` with the queries, which are the lists ``of``, in tiles."""
    for a in range(0, len(of), TILE):
        q = of[a : a + TILE]
        for b in range(0, len(x), TILE):
            distance = np.round(1 - x[b : b + TILE] @ queries[a : a + TILE].T, 12)
            bound = np.minimum(lists.bound()[q], most)
            if len(distance) > lists.k and np.isinf(lists.bound()[q]).any():
                bound = np.minimum(bound, np.partition(distance, lists.k - 1, axis=0)[lists.k - 1])
            i, j = np.nonzero(distance <= bound)
            lists.add(q[j], distance[i, j], ids[b + i], passages[b + i])


def best_passages(hits: DataFrame, top_k: int = config.TOP_K) -> DataFrame:
    """The best hit of each passage, then the best passages of each query."""
    rank = F.create_map(*[F.lit(x) for kv in LAYER_RANK.items() for x in kv])[F.col("layer")]
    best = F.row_number().over(Window.partitionBy("query_id", "passage_id").orderBy("distance", rank, "id"))
    one = hits.withColumn("b", best).where("b = 1").drop("b")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", rank, "id"))
    return one.withColumn("place", place.cast("long")).where(F.col("place") <= top_k).select("query_id", "place", "passage_id", "layer", "id", F.round(1 - F.col("distance"), 4).alias("similarity"))


def distinct_claims(items: DataFrame, threshold: float = config.CLAIM_DEDUP_THRESHOLD) -> DataFrame:
    """Claims whose similarity to every proposition of their passage stays below the threshold; an equi-join on the passage."""
    claims, props = items.where("layer = 'claim'"), items.where("layer = 'proposition'").select("passage_id", F.col("embedding").alias("other"))
    most = claims.join(props, "passage_id", "left").groupBy("id", "passage_id").agg(F.max(cosine("embedding", "other")).alias("most"))
    return most.select("id", "passage_id", (F.coalesce("most", F.lit(-1.0)) >= threshold).alias("dropped"))
