"""An index of item vectors for nearest neighbours by similarity: inverted lists around centroids, with codes of one byte a component.

Centroids are fitted on at most SAMPLE rows; every row is posted to the list of its nearest centroid, and the number of
lists grows with the root of the rows. The index is a table of blocks, of up to BLOCK rows of one list and layer: their ids,
passages, codes, the codes' errors and their vectors. It is written once, and many searches read it.

A search sends the queries to the tasks, in blocks of bounded size, with the lists that each visits; vectors are not shuffled. In
the lists that a query visits, codes give each row's similarity to within its error; only rows whose upper bound reaches
the k-th best lower bound are compared with their whole vectors, so the codes lose nothing. How many lists a query must visit is not
guessed: when the index is built, TRIES rows of the sample are searched exactly, and the number is the least that
holds the share ``recall`` of their true neighbours. Vectors in clusters need few lists; vectors without any structure
need nearly all of them, and then the codes do the sifting.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerloom.operators.retrieval import NO_PASSAGE, QUERY_BLOCK, Nearest, layer_hits, query_blocks, unit_rows
from layerloom.scratch import written

#: Rows that centroids are fitted on, at most; there are at most a fourth as many lists.
SAMPLE = 20_000
#: Rows of the sample that measure how many lists a search must visit.
TRIES = 256
#: Rows of one block of the index.
BLOCK = 4096
#: Pairs of rows and queries that wait for their whole comparison before bounds are applied to them again.
WAITING = 1 << 20
ITEM = "layer string, id long, passage_id long"
_BLOCKS = "list int, layer string, n int, ids array<long>, passages array<long>, codes binary, scales array<float>, errors array<float>, vectors binary"


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over unit rows; empty clusters keep their centroid."""
    centroids = x[:lists].copy()
    for _ in range(rounds):
        at = nearest_lists(x, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums**2).sum(1))
        centroids = np.where(norm[:, None] > 0, sums / np.where(norm == 0, 1, norm)[:, None], centroids)
    return centroids


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest lists of each row, the nearest first."""
    out = np.zeros((len(x), n), np.int64)
    for a in range(0, len(x), 1024):
        likeness = x[a : a + 1024] @ centroids.T
        out[a : a + 1024] = likeness.argmax(1)[:, None] if n == 1 else np.argsort(-likeness, axis=1, kind="stable")[:, :n]
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): ``scales`` times ``codes`` is each unit row to within ``errors`` in length, and in any unit direction."""
    scales = (np.abs(x).max(1, initial=0) / 127).astype(np.float32)
    codes = np.rint(x / np.where(scales == 0, 1, scales)[:, None]).astype(np.int8)
    errors = np.sqrt(((x - codes * scales[:, None].astype(float)) ** 2).sum(1))
    return codes, scales, (errors + 1e-5).astype(np.float32)  # and the rounding of single precision


class VectorIndex:
    """The index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("list").toArrow()
        self.centroids = np.array(rows.column("centroid").to_pylist(), float)
        self.probes = spark.read.parquet(f"{self.path}/settings").first().probes
        self.blocks = spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    @classmethod
    def build(cls, items: DataFrame, path: str, recall: float = 0.95, k: int = 10, sample: int = SAMPLE, lists: int | None = None) -> VectorIndex:
        """Writes the index of ``items`` (layer, id, passage_id, embedding). Rows without a valid vector, or with another length than most of the sample, are not in it."""
        spark, path = items.sparkSession, path.rstrip("/")
        rows = items.select("layer", F.col("id").cast("long").alias("id"), F.col("passage_id").cast("long").alias("passage_id"), "embedding").where("id IS NOT NULL AND embedding IS NOT NULL")
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
        drawn = chosen.toArrow().combine_chunks()  # SAMPLE rows at most
        by_width = unit_rows(drawn.column("embedding").combine_chunks()) if drawn.num_rows else {}
        width = max(by_width, key=lambda w: len(by_width[w][0]), default=1)
        at, x = by_width.get(width, (np.zeros(0, int), np.zeros((0, width))))
        lists = lists or max(1, min(round(rows.count() ** 0.5), len(x) // 4))
        centroids = fit_centroids(x, lists) if len(x) else np.zeros((1, width))
        table = pa.table({"list": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/centroids")
        posted = written(_posted(rows, centroids))
        _packed(posted, width).write.parquet(f"{path}/blocks")
        tries = pa.table({"query_id": drawn.column("id").combine_chunks().take(pa.array(at[:TRIES])), "embedding": pa.array(x[:TRIES].tolist(), pa.list_(pa.float64()))})
        probes = _probes(posted, items, spark.createDataFrame(tries), x[:TRIES], tries.column("query_id").to_numpy(), centroids, recall, k) if len(x) else 1
        spark.createDataFrame([(width, probes)], "width int, probes int").coalesce(1).write.parquet(f"{path}/settings")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, block_bytes: int = QUERY_BLOCK, compared: Accumulator | None = None) -> DataFrame:
        """(query_id, layer, id, passage_id, distance): the nearest ``k`` items of each layer in the lists that a query (query_id, embedding) visits. ``compared`` counts the pairs whose whole vectors were multiplied."""
        found = []
        for blocks, block in query_blocks(queries, block_bytes):
            hits = self._block_hits(block, k, min(probes or self.probes, len(self.centroids)), compared)
            found.append(hits if blocks == 1 else written(hits))
        return functools.reduce(DataFrame.unionByName, found)

    def _block_hits(self, block: pa.Table, k: int, probes: int, compared: Accumulator | None) -> DataFrame:
        width = self.centroids.shape[1]
        asked = unit_rows(block.column("embedding").combine_chunks()) if block.num_rows else {}
        at, x = asked.get(width, (np.zeros(0, int), np.zeros((0, width))))
        visits = nearest_lists(x, self.centroids, probes)
        query_ids = block.column("query_id").to_numpy()[at]
        held = self.spark.sparkContext.broadcast((query_ids, x, np.sort(visits, axis=1).astype(np.int32)))
        some = np.unique(visits).tolist()
        rows = self.blocks.where(F.col("list").isin(some)) if len(some) < min(1000, len(self.centroids)) else self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, lists = held.value
            by_list: dict[int, np.ndarray] = {}
            order = np.argsort(lists, axis=None, kind="stable")
            flat = lists.ravel()[order]
            for l in np.unique(flat).tolist():
                by_list[l] = order[slice(*np.searchsorted(flat, [l, l + 1]))] // lists.shape[1]
            sifts: dict[str, _Sift] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["list"] in by_list:
                        sifts.setdefault(row["layer"], _Sift(queries, k)).add(row, by_list[row["list"]])
            for name, sift in sifts.items():
                best, n = sift.best()
                if compared is not None:
                    compared.add(n)
                q, place = np.nonzero(np.isfinite(best.distance))
                passage = best.passage[q, place]
                columns = [pa.array(ids[q]), pa.array([name] * len(q), pa.string()), pa.array(best.id[q, place]), pa.array(passage, mask=passage == NO_PASSAGE), pa.array(best.distance[q, place])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "layer", "id", "passage_id", "distance"])

        near = rows.mapInArrow(run, "query_id long, layer string, id long, passage_id long, distance double")
        rank = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy("distance", "id"))
        return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")


class _Sift:
    """A task's candidates of one layer: rows whose similarity to a query may be among its ``k`` best, by their codes."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.single = queries, queries.astype(np.float32)
        self.sure = Nearest(len(queries), k)  # of each query the k best lower bounds, as distances
        self.pairs: list[tuple[np.ndarray, ...]] = []  # query, least distance, row
        self.rows: list[tuple[np.ndarray, ...]] = []  # id, passage, vector
        self.n_rows = self.waiting = 0

    def add(self, block: dict, of: np.ndarray) -> None:
        n, width = block["n"], self.queries.shape[1]
        codes = np.frombuffer(block["codes"], np.int8).reshape(n, width).astype(np.float32)
        distance = 1 - (codes @ self.single[of].T) * np.array(block["scales"], np.float32)[:, None]
        error = np.array(block["errors"], np.float32)[:, None]
        most = distance + error
        bound = self.sure.bound()[of]
        if n > self.sure.k:
            bound = np.minimum(bound, np.partition(most, self.sure.k - 1, axis=0)[self.sure.k - 1])
        ids = np.array(block["ids"], np.int64)
        i, j = np.nonzero(most <= bound)
        self.sure.add(of[j], most[i, j].astype(float), ids[i], np.zeros(len(i), np.int64))
        i, j = np.nonzero(distance - error <= self.sure.bound()[of])
        if not len(i):
            return
        used, row = np.unique(i, return_inverse=True)
        vectors = np.frombuffer(block["vectors"], "<f8").reshape(n, width)[used]
        passages = np.array([NO_PASSAGE if p is None else p for p in block["passages"]], np.int64)
        self.pairs.append((of[j], (distance - error)[i, j], row + self.n_rows))
        self.rows.append((ids[used], passages[used], vectors))
        self.n_rows += len(used)
        self.waiting += len(i)
        if self.waiting > WAITING:
            self._prune()

    def _prune(self) -> None:
        """Leaves out what the bounds exclude by now."""
        q, least, row = map(np.concatenate, zip(*self.pairs))
        ids, passages, vectors = map(np.concatenate, zip(*self.rows))
        keep = least <= self.sure.bound()[q]
        used, row = np.unique(row[keep], return_inverse=True)
        self.pairs, self.rows = [(q[keep], least[keep], row)], [(ids[used], passages[used], vectors[used])]
        self.n_rows, self.waiting = len(used), len(row)

    def best(self) -> tuple[Nearest, int]:
        """The nearest rows by their whole vectors, and how many pairs that compared."""
        out = Nearest(len(self.queries), self.sure.k)
        if not self.pairs:
            return out, 0
        self._prune()
        (q, _, row), (ids, passages, vectors) = self.pairs[0], self.rows[0]
        for a in range(0, len(q), 1 << 16):
            some, r = q[a : a + (1 << 16)], row[a : a + (1 << 16)]
            distance = np.round(1 - np.einsum("ij,ij->i", vectors[r], self.queries[some]), 12)
            out.add(some, distance, ids[r], passages[r])
        return out, len(q)


def _posted(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """ITEM's columns, the unit vector as bytes, and the list of each row."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # a fourth of SAMPLE vectors at most
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("embedding")).get(width, (np.zeros(0, int), np.zeros((0, width))))
            take = pa.array(at)
            lists = nearest_lists(x, held.value, 1)[:, 0].astype(np.int32)
            columns = [*(batch.column(c).take(take) for c in ("layer", "id", "passage_id")), pa.array(lists), pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["layer", "id", "passage_id", "list", "vector"])

    return rows.mapInArrow(run, ITEM + ", list int, vector binary")


def _packed(posted: DataFrame, width: int) -> DataFrame:
    """Blocks of the rows; a list with many rows is spread over several tasks, by id."""
    sorted_ = posted.repartitionByRange("list", "layer", "id").sortWithinPartitions("list", "layer", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def block() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                x = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(-1, width)
                codes, scales, errors = coded(x)
                yield pa.RecordBatch.from_pylist([{"list": key[0], "layer": key[1], "n": len(x), "ids": t.column("id").to_pylist(), "passages": t.column("passage_id").to_pylist(), "codes": codes.tobytes(), "scales": scales.tolist(), "errors": errors.tolist(), "vectors": x.tobytes()}], schema)

        schema = pa.schema([("list", pa.int32()), ("layer", pa.string()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("passages", pa.list_(pa.int64())), ("codes", pa.binary()), ("scales", pa.list_(pa.float32())), ("errors", pa.list_(pa.float32())), ("vectors", pa.binary())])
        for batch in batches:
            of, layers = batch.column("list").to_numpy(), batch.column("layer").dictionary_encode()
            names = pc.fill_null(layers.indices, -1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(names) != 0)) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                this = int(of[lo]), batch.column("layer")[lo].as_py()
                if this != key:
                    yield from block()
                    key = this
                while lo < hi:
                    n = min(hi - lo, BLOCK - sum(map(len, held)))
                    held.append(batch.slice(lo, n))
                    lo += n
                    if sum(map(len, held)) == BLOCK:
                        yield from block()
        yield from block()

    return sorted_.mapInArrow(run, _BLOCKS)


def _probes(posted: DataFrame, items: DataFrame, tries: DataFrame, x: np.ndarray, ids: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """How many lists the queries ``x`` must visit to meet the share ``recall`` of their ``k`` nearest of each layer."""
    hits = layer_hits(items, tries, -1.0, -1.0, k).select("query_id", "layer", "id")
    where = posted.select("layer", "id", "list").join(F.broadcast(hits), ["layer", "id"]).select("query_id", "list").toArrow()  # TRIES * k * layers rows
    order = nearest_lists(x, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
    query = np.argsort(ids)[np.searchsorted(np.sort(ids), where.column("query_id").to_numpy())]
    ranks = np.sort(place[query, where.column("list").to_numpy()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
