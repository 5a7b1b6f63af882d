"""Helpers that the operators of this subpackage share: scratch tables, text batches and rolling hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerloom.scratch import scratch_dir, written  # noqa: F401  (the operators take them from here)

#: Bytes of text that one vectorised step handles; the arrays of a step take some fifty times that.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a Python task.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name`` with so many underscores that no column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most about ``BATCH_BYTES``, so that a task never holds thousands of long texts at once; the session keeps that bound."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(name).rstrip("b")
    if have.isdigit() and int(have) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def ranged(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``part``: ranges of ascending doc_id of about equal numbers, a null id first; and the number of ranges. ``repartitionById`` on ``part`` gives each its own task."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)})
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    return rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part)), parts


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``limit`` bytes of text each (one row at least), and the texts of each part as UTF-8; null is empty. A column ``body`` is unpacked."""
    values = batch.column(column).cast(pa.large_binary())
    start, held, texts = 0, 0, []
    for i, v in enumerate(values):
        t = v.as_py() or b""
        if column == "body":
            t = unpacked(t)
        if texts and held + len(t) > limit:
            yield batch.slice(start, i - start), texts
            start, held, texts = i, 0, []
        texts.append(t)
        held += len(t)
    if texts:
        yield batch.slice(start), texts


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + _ZSTD.compress(text, asbytes=True)


def unpacked(body: bytes) -> bytes:
    return _ZSTD.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True) if body else b""


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with a compressed binary column ``body`` in place of ``text``, for texts that are shuffled on their way to Python tasks."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(map(_pack, texts), pa.binary())], [*others, "body"])

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("body", T.BinaryType())])
    return rows.select(*others, "text").transform(in_arrow, run, schema)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts with a line end after each, where each text starts, and its length."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1])).astype(np.int64)
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts, lens


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of codes[i:j], modulo 2**64."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def byte_hash(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_CODE[data])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that do not depend on where they stand."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def gram_hash(prefix: np.ndarray, gram: int) -> np.ndarray:
    """``span_hash`` of every ``gram`` neighbours, without look-ups."""
    x = prefix[gram:] - prefix[: len(prefix) - gram]
    x *= powers(len(prefix))[1][: len(x)]
    x += np.uint64(gram)
    return mixed(x)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last entry must be False."""
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes between words in the sense of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def blank_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between white space, A-Z lower-cased, and where each text's words start (one entry more than texts)."""
    data, starts, _ = joined(texts)
    data = LOWER[data]
    b, e = word_spans(~SPACE[data])
    return span_hash(byte_hash(data), b, e), np.append(np.searchsorted(b, starts), len(b))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i], ..., starts[i] + counts[i] - 1, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` entries, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x
