"""Token-id files coded by an adaptive context-mixing range coder.

Documents stand in ascending order of id. A shard's ids are cut into segments of whole documents (a row of the file
table: the documents' ids and lengths, and the coded blocks), and a segment into blocks of at most ``BLOCK`` ids. Each block
is coded with a model that starts anew, and carries its number of ids, their crc32 and that of its own bytes, so blocks are
read independently and damage is found.

A block's ids lie in lanes, runs that are coded in step with each other, one id of each at a time; all lanes share the block's
model. Model, for each id: what mostly followed the two ids before (order 2) or else the one before (order 1) is the
candidate; its chance mixes, in the logistic domain with weights that learn, the hit rates by order-2 confidence, by order-1
confidence, and by the candidate's own frequency (order 0). If the candidate fails, order 0 codes the id by its count among
the ids so far that failed too, or as a new one: the length of its number by the lengths of the new ones before, then its
bits. Candidates learn after each step; rates, weights and counts whenever the ids coded have grown by a quarter, from all
steps since. Each lane's interval has 64 bits and gives off 32 at a time. All arithmetic is on integers.

Cases: a null text is empty and becomes the end id alone; documents with one id follow each other in order of a hash of the text; a
null id comes first; an empty table writes no segments and reads none; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerloom.llm import tokens
from layerloom.llm.common import in_arrow, packed, ranged, scratch_dir, slices

BLOCK = 1 << 23
#: Ids of a segment, mostly one block: what a task holds at a time.
SEGMENT = 4_000_000
END_ID = 0
HEADER = struct.Struct("<4sHIIII")  # magic, version, ids, crc32 of the ids, 32-bit words, crc32 of what follows: each lane's number of words, the words
MAGIC, VERSION = b"LLCM", 3
FILE = "part int, seq int, n_ids long, doc_ids array<long>, n_tokens array<int>, blocks array<binary>"

_SQUASH = np.array([round(4096 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int64)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)
_LENGTH = np.array([n.bit_length() for n in range(65537)], np.int64)  # bits of a number
#: A block has at most this many lanes, and a lane this many ids at least where there are more.
LANES, LANE = 8192, 256
#: Order 0 codes ids, lengths of new ids plus one (1 to 17), and that nothing is left to code.
_NEW, _NOTHING = 65536, 65536 + 18
#: A cell is what the chance depends on: order-2 confidence (4 bits), order-1 confidence (4), whether order 1 agrees, frequency (4); its part for each of the mixed rates.
_CELLS = 1 << 13
_RATES = (np.arange(_CELLS) >> 9, np.arange(_CELLS) >> 4 & 31, np.arange(_CELLS) & 15 | (np.arange(_CELLS) >= 512) * 16)
#: What an entry's confidence changes by when it failed (first 16) or held.
_STEP = np.array([0, 0, *(-(c + 1 >> 1) for c in range(2, 16)), *[1] * 15, 0], np.int32)
_WORD, _FULL, _LOW, _ALL = np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64((1 << 64) - 1)


class Model:
    """Predictions for the next id of each lane."""

    def __init__(self, lanes: int, n: int, find: bool = False):
        self.bits, self.hash_bits = min(18, max(12, (n + 64).bit_length())), min(18, max(8, n.bit_length() - 1))
        # what follows an id, and a hash of two: id << 4 | confidence; 0: nothing yet
        self.next1, self.next2 = np.zeros(65536, np.int32), np.zeros(1 << self.hash_bits, np.int32)
        self.a = self.ahead = np.zeros(lanes, np.int64)  # the last id, and what the one before adds to the hash
        self.count = np.zeros(_NOTHING, np.int32)
        self.count[_NEW + 1 :] = 1
        self.span = np.zeros(_NOTHING + 1, np.uint64)  # order 0: start << 32 | width, of 2**bits
        self.span[_NOTHING] = 1 << self.bits
        self.often = np.zeros(65536, np.uint8)
        self.find, self.kind = find, None  # of each of 2**bits, whose it is; for decoding
        self.hits, self.tries = ([np.zeros(32, np.int64) for _ in _RATES] for _ in range(2))
        self.weight = [1 << 15] * 3
        self.cells, self.ids = [], []  # since counts were last taken
        self.counted = self.since = 0
        self._predictions()

    def _count(self) -> None:
        cell, ids = np.concatenate(self.cells), np.concatenate(self.ids)
        self.cells.clear()
        self.ids.clear()
        self.kind = None
        made = np.bincount(cell, minlength=2 * _CELLS)
        hit = made[_CELLS:]
        tries = made[:_CELLS] + hit
        err, curve = (hit << 12) - tries * self.p, tries * (self.p * (4096 - self.p) >> 12)
        for k, of in enumerate(_RATES):
            x = self.inputs[k]
            step = (int((err * x).sum()) << 16) // (3 * int((curve * (x * x >> 8)).sum()) + 256)
            self.weight[k] += max(-32768, min(32768, step))
            for total, what in ((self.hits[k], hit), (self.tries[k], tries)):
                np.add.at(total, of, what)
        ids = ids[cell < _CELLS]
        new = ids[self.span.take(ids) == 0].astype(np.int64)
        np.add.at(self.count, ids, np.int32(1))
        lengths = np.bincount(_LENGTH.take(new + 1), minlength=18)[1:]
        self.count[_NEW + 1 :] = np.maximum(1, lengths * int(self.count[:_NEW].sum()) // max(1, len(ids)))
        self.counted += self.since
        self.since = 0

    def _predictions(self) -> None:
        kinds = np.flatnonzero(self.count)
        n = self.count[kinds].astype(np.int64)
        width = n * ((1 << self.bits) - len(kinds)) // int(n.sum()) + 1
        width[n.argmax()] += (1 << self.bits) - int(width.sum())
        self.span[kinds] = (np.cumsum(width) - width << 32) + width
        ids = kinds[: np.searchsorted(kinds, _NEW)]
        self.often[ids] = np.maximum(_LENGTH.take(width[: len(ids)] >> max(0, self.bits - 16), mode="clip") - 1, 0)
        if self.find:
            self.kind = np.repeat(kinds.astype(np.int32), width)
        self.inputs = [_STRETCH.take((h * 8190 + 4095) // (n * 2 + 2))[of] for h, n, of in zip(self.hits, self.tries, _RATES)]
        dot = sum(w * x for w, x in zip(self.weight, self.inputs)) >> 16
        self.p = np.clip(_SQUASH.take(dot + 2047, mode="clip"), 16, 4080)
        self.chance = self.p.astype(np.uint64)

    def candidate(self, live: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of the first ``live`` lanes and their chances, of 4,096."""
        if live < len(self.a):
            self.a, self.ahead = self.a[:live], self.ahead[:live]
        if self.since > self.counted >> 2:
            self._count()
            self._predictions()
        self.at2 = (self.a * 0x9E3779B1 + self.ahead >> 13) & ((1 << self.hash_bits) - 1)
        self.t1, self.t2 = self.next1.take(self.a), self.next2.take(self.at2)
        best = self.t2 + self.t1 * (self.t2 == 0)
        cand = best >> 4
        self.cell = ((self.t2 << 4 | self.t1 & 15) & 255) << 5 | ((self.t1 ^ best) < 16).astype(np.int32) << 4 | self.often.take(cand)
        return cand, self.chance.take(self.cell)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """``ids``: those that came."""
        self.cells.append((self.cell | hit.astype(np.int32) << 13).astype(np.uint16))
        self.ids.append(ids.astype(np.uint16))
        self.since += len(ids)
        x = ids.astype(np.int32) << 4
        for nxt, t, at in ((self.next1, self.t1, self.a), (self.next2, self.t2, self.at2)):
            c = t & 15
            c += 16 * (t - c == x)
            changed = t + _STEP.take(c)
            nxt[at] = changed + (x + 1 - changed) * (c < 2)  # of lanes with one entry the last counts
        self.a, self.ahead = ids, self.a * 0x85EBCA6B


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes of a block of ``n`` ids, steps, and lanes that take part in the last step."""
    lanes = max(1, min(LANES, n // LANE))
    return lanes, -(-n // lanes), (n - 1) % lanes + 1


def _runs(ids: np.ndarray, x: np.ndarray, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Views of ``ids`` and of ``x`` (a row for each step) that match."""
    steps, lanes = x.shape
    yield ids[: last * steps].reshape(last, steps), x[:, :last].T
    if last < lanes:
        yield ids[last * steps :].reshape(lanes - last, steps - 1), x[:-1, last:].T


def _encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes, steps, last = _shape(n)
    x = np.zeros((steps, lanes), np.uint16)
    for run, place in _runs(ids, x, last):
        place[:] = run
    model = Model(lanes, n)
    low, rng, carry = np.zeros(lanes, np.uint64), np.full(lanes, _ALL), np.zeros(lanes, bool)
    words, carries, owners = [], [], []

    def shift(lane: np.ndarray) -> None:
        v = low.take(lane)
        words.append((v >> _WORD).astype("<u4"))
        carries.append(carry.take(lane))
        owners.append(lane.astype(np.uint16))
        low[lane], carry[lane], rng[lane] = v << _WORD, False, rng.take(lane) << _WORD

    def add(lane: np.ndarray, more: np.ndarray) -> None:
        was = low.take(lane)
        now = was + more
        low[lane], carry[lane] = now, carry.take(lane) | (now < was)

    for t in range(steps):
        live = lanes if t < steps - 1 else last
        s = x[t, :live].astype(np.int64)
        cand, chance = model.candidate(live)
        hit = cand == s
        r, v = rng[:live], low[:live]
        w = (r >> np.uint64(12)) * chance
        of_hit = np.uint64(0) - hit
        rest = r - w
        rest ^= (rest ^ w) & of_hit
        rest >>= np.uint64(model.bits)
        span = model.span.take(s ^ (s ^ _NOTHING) & of_hit.view(np.int64))
        new = np.flatnonzero(span == 0)
        if len(new):
            number = s[new] + 1
            length = _LENGTH.take(number)
            span[new] = model.span.take(_NEW + length)
        w &= ~of_hit
        w += rest * (span >> _WORD)
        w += v
        carry[:live] |= w < v
        v[:] = w
        r[:] = rest * (span & _LOW)
        shift(np.flatnonzero(r < _FULL))
        if len(new):
            length = (length - 1).astype(np.uint64)
            unit = rng[new] >> length
            add(new, unit * (number.astype(np.uint64) ^ np.uint64(1) << length))
            rng[new] = unit
            shift(new[unit < _FULL])
        model.learn(s, hit)
    del model, x
    every = np.arange(lanes)
    add(every, _LOW)  # the word that follows is the end of a number inside the last interval
    shift(every)
    owner, word, up = (_taken(runs) for runs in (owners, words, carries))
    by = np.argsort(owner, kind="stable")
    word, up = word[by], np.flatnonzero(up[by]) - 1
    while len(up):
        word[up] += np.uint32(1)
        up = up[word[up] == 0] - 1
    body = np.bincount(owner, minlength=lanes).astype("<u2").tobytes() + word.tobytes()
    return HEADER.pack(MAGIC, VERSION, n, zlib.crc32(ids.astype("<u4")), len(word), zlib.crc32(body)) + body


def _decode(block: bytes, n_ids: int) -> np.ndarray:
    """A row of ids for each step."""
    lanes, steps, last = _shape(n_ids)
    at = HEADER.size + 2 * lanes
    n = np.frombuffer(block, "<u2", lanes, HEADER.size).astype(np.int64)
    words, ends = np.frombuffer(block, "<u4", offset=at), np.cumsum(n)
    at, rng = ends - n, np.full(lanes, _ALL)
    value = words.take(at).astype(np.uint64) << _WORD | words.take(at + 1, mode="clip") * (n > 1)  # past its last word a lane has zeros
    at += 2
    x = np.zeros((steps, lanes), np.uint16)
    model = Model(lanes, n_ids, find=True)

    def shift(lane: np.ndarray) -> None:
        k = at.take(lane)
        value[lane] = value.take(lane) << _WORD | words.take(k, mode="clip") * (k < ends.take(lane))
        at[lane], rng[lane] = k + 1, rng.take(lane) << _WORD

    for t in range(steps):
        live = lanes if t < steps - 1 else last
        cand, chance = model.candidate(live)
        r, v = rng[:live], value[:live]
        w = (r >> np.uint64(12)) * chance
        hit = v < w
        of_hit = np.uint64(0) - hit
        rest = r - w
        rest ^= (rest ^ w) & of_hit
        rest >>= np.uint64(model.bits)
        w &= ~of_hit
        v -= w
        kind = model.kind.take((v // rest).view(np.int64), mode="clip").astype(np.int64)
        s = kind ^ (kind ^ cand) & of_hit.view(np.int64)
        span = model.span.take(kind ^ (kind ^ _NOTHING) & of_hit.view(np.int64))
        v -= rest * (span >> _WORD)
        r[:] = rest * (span & _LOW)
        shift(np.flatnonzero(r < _FULL))
        new = np.flatnonzero(s >= _NEW)
        if len(new):
            length = (s[new] - _NEW - 1).astype(np.uint64)
            unit = rng[new] >> length
            number = np.minimum(value[new] // unit, (np.uint64(1) << length) - np.uint64(1))
            value[new] -= unit * number
            rng[new] = unit
            s[new] = (number | np.uint64(1) << length).astype(np.int64) - 1
            shift(new[unit < _FULL])
        model.learn(s, hit)
        x[t, :live] = s
    return x


def _sizes(n: int, block: int) -> np.ndarray:
    """Ids of each block: as few blocks as hold ``n``, as even as can be, the longer ones first."""
    blocks = -(-n // block)
    return n // blocks + (np.arange(blocks) < n % blocks)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """In 16 bits where they fit; ``encode`` refuses the others."""
    return ids.astype(np.uint16) if not len(ids) or 0 <= int(ids.min()) <= int(ids.max()) < 65536 else ids


def _taken(runs: list[np.ndarray]) -> np.ndarray:
    """All runs as one, which leaves the list empty."""
    ids = np.concatenate(runs)
    runs.clear()
    return ids


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The coded blocks of a run of ids below 65,536."""
    if not len(ids):
        return []
    ids = np.asarray(ids)
    if ids.min() < 0 or ids.max() > 65535:
        raise ValueError("this format holds ids from 0 to 65,535")
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block has 1 to {BLOCK:,} ids")
    n = _sizes(len(ids), block)
    return [_encode(ids[e - k : e]) for k, e in zip(n.tolist(), np.cumsum(n).tolist())]


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks, one after the other; raises ValueError where a block is damaged."""
    heads = []
    for b in blocks:
        magic, version, n, crc, words, own = HEADER.unpack_from(b) if len(b) >= HEADER.size else (b"", 0, 0, 0, 0, 0)
        if magic != MAGIC or version != VERSION or not 0 < n <= BLOCK or len(b) != HEADER.size + 2 * _shape(n)[0] + 4 * words or zlib.crc32(memoryview(b)[HEADER.size :]) != own:
            raise ValueError("not a block of this format")
        heads.append((n, crc))
    made = [_decode(b, n) for b, (n, _) in zip(blocks, heads)]
    out, at = np.zeros(sum(n for n, _ in heads), "<u4"), 0
    for x, (n, crc) in zip(made, heads):
        row = out[at : at + n]
        for run, place in _runs(row, x, _shape(n)[2]):
            run[:] = place
        if zlib.crc32(row) != crc:
            raise ValueError("a block's checksum differs")
        at += n
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Writes the ids of all documents, each with the end id after it, in ascending order of doc_id. Texts move once."""
    rows, parts = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = None, 0
        docs_, lens, runs = [], [], []  # of the segment
        pa.default_memory_pool().release_unused()  # what the worker's tasks before have left

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            if docs_:
                n, made = sum(map(len, runs)), encode(_taken(runs), block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([docs_], pa.list_(pa.int64())),
                     pa.array([np.concatenate(lens)], pa.list_(pa.int32())), pa.array([made], pa.list_(pa.binary()))], ["part", "seq", "n_ids", "doc_ids", "n_tokens", "blocks"])
                seq += 1
                docs_.clear()
                lens.clear()

        for batch in batches:
            for piece, texts in slices(batch, "body"):
                parts_ = piece.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts_)) + 1).tolist(), len(texts)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if parts_[lo] != part or sum(map(len, runs)) >= segment:
                        yield from flush()
                    if parts_[lo] != part:
                        part, seq = int(parts_[lo]), 0
                    ids, n = tokens.ids(texts[lo:hi], tokenizer)
                    docs_.extend(piece.column("doc_id").slice(lo, hi - lo).to_pylist())
                    runs.append(_narrow(np.insert(ids, np.cumsum(n), end_id)))
                    lens.append((n + 1).astype(np.int32))
        yield from flush()

    rows = packed(rows.withColumn("text_hash", F.xxhash64("text"))).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "text_hash")
    rows.select("part", "doc_id", "body").transform(in_arrow, run, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files, from the decoded blocks: doc_id, start, n_tokens, ids_crc32, and the ids if asked."""
    files = spark.read.schema(FILE).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # a worker that has written holds pieces, which reading does not need
        pa.default_memory_pool().release_unused()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                raw = decode(row.pop("blocks"))
                ends = np.cumsum(row["n_tokens"])
                cuts = list(zip((ends - row["n_tokens"]).tolist(), ends.tolist()))
                n = len(cuts)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([s for s, _ in cuts], pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(raw[s:e]) for s, e in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([raw[s:e].tolist() for s, e in cuts], pa.list_(pa.int64()))] * with_ids, ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    read = files.select("part", "seq", "doc_ids", "n_tokens", "blocks").transform(in_arrow, run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("base"))  # one row for each range
    segments = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before("part", "seq")), F.lit(0)).alias("ahead")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("ahead")).alias("first"))
    return read.join(segments, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the files and returns what reading them back gives."""
    path = path or scratch_dir(docs.sparkSession)
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
