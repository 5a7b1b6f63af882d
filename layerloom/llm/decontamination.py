"""Benchmark decontamination with suffix arrays over shards of the corpus.

Each task cuts its documents into shards of bounded size and builds a suffix array over the words of a shard.
Every suffix of every benchmark item is then binary-searched in it, word by word, which gives its longest verbatim
match and all places of its window of ``window`` words. A suffix of the shard that meets a word outside the
benchmark's vocabulary before the shortest window is full cannot match, so the array leaves it out. Documents are not
shuffled. The benchmark travels in blocks of at most ``block_bytes`` of text: one broadcast per block, of which a task
holds one at a time, so a benchmark of any size is matched whole.

Cases: a null or empty text has no words; an item without words matches nothing; an item with fewer words than the
window is one window; repeated items with one id count once; an item whose id is null hits but is not listed;
repeated documents are judged row by row; columns of other names are ignored or passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import LOWER, byte_hash, in_arrow, joined, ranges, slices, span_hash, word_spans

WINDOW = 10
BLOCK_BYTES = 8 << 20
HELD_BYTES = 32 << 20
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>"
MATCH = "item_id long, item_pos long, doc_id long, doc_pos long, n_words long"


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and where each text's words start (one entry more than texts)."""
    data, starts, _ = joined(texts)
    data = LOWER[data]
    b, e = word_spans(_WORD[data])
    return span_hash(byte_hash(data), b, e), np.append(np.searchsorted(b, starts), len(b))


class TestBlock:
    """The suffixes of a block of benchmark items as word ids."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        h, at = words(texts)
        self.vocab = np.unique(h)
        n = np.diff(at)
        self.window_of = np.minimum(window, n)
        self.item_ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.known = np.array([i is not None for i in ids], bool)
        self.words = (np.searchsorted(self.vocab, h) + 1).astype(np.int64)
        self.least = int(self.window_of[n > 0].min()) if (n > 0).any() else 0
        self.item = np.repeat(np.arange(len(n)), n)
        self.pos = np.arange(len(h)) - np.repeat(at[:-1], n)
        self.end = np.repeat(at[1:], n)
        full = self.end - np.arange(len(h)) >= self.window_of[self.item]
        self.suffix = np.flatnonzero(full)


def suffix_array(seq: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``seq`` that start at ``at``, each up to ``run`` words long, by rank doubling; ``seq`` is 0 where no run is, and at its end."""
    rank, width = seq, 1
    while len(at) and width < int(run.max()):
        key = rank << 32
        key[:-width] |= rank[width:]  # what follows another run's end only parts suffixes that are equal to their ends
        distinct, rank = np.unique(key, return_inverse=True)
        rank = np.where(seq > 0, rank + 1, 0)
        if len(distinct) == len(seq):
            break
        width *= 2
    return np.argsort(rank[at], kind="stable")


def search(block: TestBlock, seq: np.ndarray, at: np.ndarray, run: np.ndarray):
    """Each suffix of the block against the sorted suffixes ``at``: intervals after its window, its longest match and one place of it."""
    col = lambda i, d: np.where(d < run[i], seq[np.minimum(at[i] + d, len(seq) - 1)], 0)
    m = len(at)
    first = np.searchsorted(seq[at], np.arange(len(block.vocab) + 2))
    s = block.suffix
    w = block.words[s]
    lo, hi = first[w], first[w + 1]
    live = np.flatnonzero(hi > lo)
    need = block.window_of[block.item[s]]
    win = np.zeros((len(s), 2), np.int64)
    best, place = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    d = 1
    while len(live):
        best[live], place[live] = d, at[lo[live]]
        done = live[need[live] == d]
        win[done, 0], win[done, 1] = lo[done], hi[done]
        live = live[s[live] + d < block.end[s[live]]]
        if not len(live):
            break
        want = block.words[s[live] + d]
        bounds = []
        for right in (0, 1):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                less = col(np.minimum(mid, m - 1), d) < want + right
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        lo[live], hi[live] = bounds
        live = live[bounds[1] > bounds[0]]
        d += 1
    return win, best, place


class Shard:
    """The words of some documents, and what the blocks of the benchmark have matched in them."""

    def __init__(self, texts: list[bytes]):
        self.hash, at = words(texts)
        n = np.diff(at)
        self.n = n
        self.begin = at[:-1] + np.arange(len(n))  # a gap after each document
        self.place = np.arange(len(self.hash)) + np.repeat(np.arange(len(n)), n)
        self.size = len(self.hash) + len(n)
        self.cover = np.zeros(self.size + 1, np.int64)
        self.items: dict[int, set] = {}

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def match(self, block: TestBlock):
        """Marks the windows that occur; returns (suffix, length, place) of the longest matches that fill a window."""
        none = np.zeros(0, np.int64)
        if not len(block.suffix) or not len(self.hash):
            return none, none, none
        got = np.minimum(np.searchsorted(block.vocab, self.hash), len(block.vocab) - 1)
        seq = np.zeros(self.size, np.int64)
        seq[self.place] = np.where(block.vocab[got] == self.hash, got + 1, 0)
        gaps = np.flatnonzero(seq == 0)
        known = np.flatnonzero(seq)
        run = gaps[np.searchsorted(gaps, known)] - known
        if not (run >= block.least).any():
            return none, none, none
        # only runs that can hold a window go into the array, each with a gap after it
        head = np.concatenate(([True], np.diff(known) != 1))
        of = np.cumsum(head) - 1
        use = run[head][of] >= block.least
        place = np.arange(int(use.sum())) + of[use] - np.concatenate(([0], np.cumsum(run[head] < block.least)))[of[use]]
        short = np.zeros(int(place[-1]) + 2, np.int64)
        short[place] = seq[known[use]]
        at, run = known[use], run[use]
        fits = run >= block.least
        at, run = at[fits], run[fits]
        order = suffix_array(short, place[fits], run)
        at, run = at[order], run[order]
        win, best, place = search(block, seq, at, run)
        hit = np.flatnonzero(win[:, 1] > win[:, 0])
        item = block.item[block.suffix[hit]]
        need = block.window_of[item]
        span, which = np.unique(np.stack([win[hit, 0], win[hit, 1], need], 1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        if len(span):
            n = span[:, 1] - span[:, 0]
            where = at[ranges(span[:, 0], n)]
            np.add.at(self.cover, where, 1)
            np.add.at(self.cover, where + np.repeat(span[:, 2], n), -1)
            pairs = np.unique(np.stack([np.repeat(np.arange(len(span)), n), self.doc_of(where)], 1), axis=0)
            listed = block.known[item]
            by = np.unique(np.stack([which[listed], block.item_ids[item[listed]]], 1), axis=0)
            first = np.searchsorted(by[:, 0], np.arange(len(span) + 1))
            for k, doc in pairs.tolist():
                self.items.setdefault(doc, set()).update(by[first[k] : first[k + 1], 1].tolist())
        long = np.flatnonzero(best >= block.window_of[block.item[block.suffix]])
        return block.suffix[long], best[long], place[long]

    def verdicts(self) -> tuple[list[int], list[list[int]]]:
        hit = np.concatenate(([0], np.cumsum(np.cumsum(self.cover[:-1]) > 0)))
        return (hit[self.begin + self.n] - hit[self.begin]).tolist(), [sorted(self.items.get(i, ()), key=str) for i in range(len(self.n))]


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of the benchmark, each of about ``block_bytes`` of text; the driver holds one at a time."""
    spark, b = benchmark.sparkSession, benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // block_bytes)) or 1
    out = []
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()
        out.append(spark.sparkContext.broadcast(TestBlock([r[0] for r in rows], [r[1].encode() for r in rows], window)))
    return out


def _matched(batches: Iterator[pa.RecordBatch], tests: list) -> Iterator[tuple[pa.RecordBatch, Shard, list]]:
    """(rows, their shard, its matches by block). With several blocks, shards of ``HELD_BYTES`` of text wait for each block in turn."""
    held: list[tuple[pa.RecordBatch, Shard, list]] = []
    size = 0
    for batch in batches:
        for part, texts in slices(batch):
            held.append((part, Shard(texts), []))
            size += sum(map(len, texts))
            if len(tests) == 1 or size > HELD_BYTES:
                yield from _through(held, tests)
                held, size = [], 0
    yield from _through(held, tests)


def _through(held: list[tuple[pa.RecordBatch, Shard, list]], tests: list) -> list[tuple[pa.RecordBatch, Shard, list]]:
    for bc in tests if held else ():
        block = bc.value
        for _, shard, found in held:
            found.append((block.item_ids, block.item, block.pos, *shard.match(block)))
        if len(tests) > 1:  # one block in memory at a time
            del block
            bc.__dict__.pop("_value", None)
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside an occurrence of a window, and the items that hit it."""
    tests = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, _ in _matched(batches, tests):
            n_hit, items = shard.verdicts()
            names = [",".join(map(str, x)) for x in items]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(shard.n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]), pa.array([x > 0 for x in n_hit]), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, run, VERDICT)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per benchmark suffix with a match of a whole window: the longest verbatim match over all shards and its first place."""
    tests = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, found in _matched(batches, tests):
            ids = np.array([-1 if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
            for item_ids, item, pos, s, n, place in found:
                if len(s):
                    doc = shard.doc_of(place)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (item_ids[item[s]], pos[s], ids[doc], place - shard.begin[doc], n)], ["item_id", "item_pos", "doc_id", "doc_pos", "n_words"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, run, MATCH)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_pos")).alias("m")
    return found.groupBy("item_id", "item_pos").agg(best).select("item_id", "item_pos", F.col("m.doc_id"), F.col("m.doc_pos"), (-F.col("m.n")).alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no window hits, with all their columns."""
    tests = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard, _ in _matched(batches, tests):
            yield part.filter(pa.array([x == 0 for x in shard.verdicts()[0]], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)
