"""Document fingerprints by winnowing.

The bytes of a text are cut into rolling k-grams; of each window of consecutive k-grams the one with the least hash is
kept, the rightmost of equal ones, with its position. So any passage of ``GRAM + WINDOW - 1`` bytes that two texts
share leaves at least one common entry (the match guarantee). A fingerprint is the hex text of its entries in order,
each a gap to the position before (2 bytes) and a hash (4 bytes). The likeness of two is the Jaccard index of their
sets of hashes.

A text of fewer bytes than a k-gram is one gram as it is; one with fewer k-grams than a window is one window.

``compare_edited`` needs each document's successor by id. Documents are dealt into ranges of ids by quantiles and
sorted there; each range also gets the first document of the next one. Texts move once.

Cases: a null text is empty and has the empty fingerprint; two empty ones have likeness 1, an empty and another 0;
a null id comes first; documents with one id follow each other in order of a hash of the text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import CHUNK_BYTES, byte_hash, gram_hash, in_arrow, joined, packed, ranged, ranges, slices, sliding_min, span_hash, unpacked

GRAM = 8
WINDOW = 9
_ENTRY = np.dtype([("gap", "<u2"), ("hash", "<u4")])
_LAST = np.uint64(0xFFFFFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def chosen(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing over texts that stand in one buffer: (hash of each gram, where each full window's least gram is, the windows' starts, the same for texts of one short window as (text, place) pairs)."""
    n = len(data)
    h = np.zeros(n, np.uint64)
    key = np.full(n, _NONE)
    if n >= gram:
        m = n - gram + 1
        h[:m] = gram_hash(byte_hash(data), gram)
        np.bitwise_and(h[:m], ~_LAST, out=key[:m])
        key[:m] |= np.arange(int(_LAST), int(_LAST) - m, -1, dtype=np.uint64)
    grams = np.maximum(lens - gram + 1, 0)
    full = np.flatnonzero(grams >= window)
    spans = grams[full] - window + 1
    first = ranges(starts[full], spans)
    least = (_LAST - (sliding_min(key, window)[first] & _LAST)).astype(np.int64) if len(first) else first
    short = np.flatnonzero((grams > 0) & (grams < window))
    if len(short):
        edges = np.stack([starts[short], starts[short] + grams[short]], 1).ravel()
        place = (_LAST - (np.minimum.reduceat(key, edges)[::2] & _LAST)).astype(np.int64)
    else:
        place = np.zeros(0, np.int64)
    return h, least, first, np.stack([short, place], 1)


def fingerprints(texts: list[bytes], gram: int = GRAM, window: int = WINDOW) -> list[np.ndarray]:
    """Entries (position, hash) of each text, in order of position."""
    data, starts, lens = joined(texts)
    h, least, _, short = chosen(data, starts, lens, gram, window)
    place = np.unique(np.concatenate([least, short[:, 1]]))
    tiny = np.flatnonzero((lens > 0) & (lens < gram))
    if len(tiny):
        h = h.copy()
        h[starts[tiny]] = span_hash(byte_hash(data), starts[tiny], starts[tiny] + lens[tiny])
        place = np.unique(np.concatenate([place, starts[tiny]]))
    cut = np.searchsorted(place, np.append(starts, len(data)))
    out = []
    for i in range(len(texts)):
        p = place[cut[i] : cut[i + 1]]
        out.append(np.stack([p - starts[i], (h[p] & _LAST).astype(np.int64)], 1))
    return out


def encoded(entries: np.ndarray) -> str:
    x = np.zeros(len(entries), _ENTRY)
    x["gap"], x["hash"] = np.diff(entries[:, 0], prepend=0), entries[:, 1]
    return x.tobytes().hex()


def decoded(text: str) -> np.ndarray:
    """Entries (position, hash) of a fingerprint."""
    x = np.frombuffer(bytes.fromhex(text), _ENTRY)
    return np.stack([np.cumsum(x["gap"].astype(np.int64)), x["hash"].astype(np.int64)], 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(encoded, fingerprints(texts, gram, window)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, run, "doc_id long, fingerprint string")


def followed(docs: DataFrame) -> DataFrame:
    """(part, tail, doc_id, body) sorted inside partitions: ranges of ids, each ended by a row with ``tail`` = 1 that repeats the first document after it (after the last range: of all)."""
    spark = docs.sparkSession
    rows, parts = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    firsts = [(r.part, r.first.doc_id) for r in rows.groupBy("part").agg(first).orderBy("part").collect()]  # one row for each range
    if not firsts:
        return packed(rows.select("part", F.lit(0).alias("tail"), "doc_id", "text"))
    before = spark.createDataFrame([(firsts[i - 1][0], d) for i, (_, d) in enumerate(firsts)], "part int, first_id long")
    ids = [d for _, d in firsts if d is not None]
    heads = rows.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if len(ids) < len(firsts) else F.lit(False))).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    tails = heads.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("part", F.lit(1).alias("tail"), "doc_id", "text")
    both = rows.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    both = packed(both.withColumn("text_hash", F.xxhash64("text")))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text_hash")


def compare_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the second half replaced by the start of the next document), and the likeness to the edited text and to the next document."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """Of each row but the last, if the next stands in its range."""
        use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        edited = [(t := texts[i])[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i in use]
        raw = [t.encode() for t in edited]
        own = fingerprints([t.encode() for t in texts], gram, window)
        new = fingerprints(raw, gram, window)
        sets = [np.unique(x[:, 1]) for x in own]
        near = [(likeness(sets[i], np.unique(e[:, 1])), likeness(sets[i], sets[i + 1])) for i, e in zip(use, new)]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in use], pa.int64()), pa.array([len(texts[i]) for i in use], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
             pa.array([encoded(own[i]) for i in use], pa.string()), pa.array(map(encoded, new), pa.string()), pa.array([x for x, _ in near], pa.float64()), pa.array([y for _, y in near], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for *row, body in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "body"))):
                held.append((*row, unpacked(body).decode()))
                size += len(held[-1][3])
                if size > CHUNK_BYTES // 2:
                    yield finish(held)
                    held, size = held[-1:], len(held[-1][3])
        yield finish(held)

    return followed(docs).transform(in_arrow, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
