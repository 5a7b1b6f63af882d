"""Best-fit packing of tokenised documents into sequences of at most ``cap`` tokens.

Only a document longer than ``cap`` is cut: into pieces of ``cap`` tokens, of which the first may be shorter. A piece of
``cap`` tokens is a sequence of its own. The others are dealt by hash into groups of about GROUP pieces, and a task packs
a group: best fit in falling order of length first, then local search, which moves a piece, or exchanges it for one or two
others, between two underfull sequences whenever that raises the sum of the squared fills, until sequences run empty.
The emptiest sequences of every group (LEFT of them) are dissolved and meet those of other groups in the next round, until
one group is left; each round has at most half the groups of the one before. A task holds one group at a time: about GROUP
pieces, or those of LEFT sequences of two groups.

Every written piece has a number of its own, and a sequence is named by its first piece, so that names need no agreement.

Cases: a null text is empty, and has the end id alone; repeated rows each have pieces of their own; a null id stays null;
an empty table gives no rows; other columns are ignored. One text is tokenised at a time at least, so a task needs memory
for its longest text, as in the other operators.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm import tokens
from layerloom.llm.common import in_arrow, ranges, slices, written

CAP = 1024
END_ID = 2
#: Pieces that are packed together, in one task; no piece is left out, and more of them only pack closer.
GROUP = 1 << 14
#: The emptiest sequences of a group that meet other groups'.
LEFT = 8
#: Sweeps of the local search over the underfull sequences; it ends before if a sweep changes nothing, or no sequence can run empty.
SWEEPS = 30
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: np.ndarray, cap: int = CAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``n`` tokens (one at least): of each piece its document, its number, where it starts and its length."""
    count = -(-n // cap)
    doc = np.repeat(np.arange(len(n)), count)
    piece = ranges(np.zeros(len(n), np.int64), count)
    first = (n - (count - 1) * cap)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * cap), np.where(piece == 0, first, cap)


def pieces(docs: DataFrame, tokenizer: str, cap: int = CAP, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """PIECE's columns of each document's ids and the end id; ``with_ids`` adds the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                ids, count = tokens.ids(texts, tokenizer)
                ends = np.cumsum(count + 1)
                whole = np.full(int(ends[-1]), end_id, "<u4")
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                doc, piece, start, length = cut_lengths(count + 1, cap)
                lo = (ends - count - 1)[doc] + start
                view = memoryview(whole).cast("B")
                spans = [view[4 * a : 4 * b] for a, b in zip(lo.tolist(), (lo + length).tolist())]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, spans), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(map(bytes, spans), pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(in_arrow, run, PIECE + (", ids binary" if with_ids else ""))


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Places of ``lengths``, which fall, by sequence: each goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    some = 0  # bit r is set if a sequence has room for r
    for i, n in enumerate(lengths):
        if fitting := some >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            room, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        if room := room - n:
            by_room[room].append(b)
            some |= 1 << room
    return bins


class Exchange:
    """Local search over the underfull ones of ``bins`` (places of ``lengths``), which it changes."""

    def __init__(self, lengths: list[int], bins: list[list[int]], cap: int):
        self.lengths, self.cap, self.bins = lengths, cap, [set(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.least = -(-sum(self.fill) // cap)
        self.live = sum(f > 0 for f in self.fill)
        self.at: dict[int, int] = {}  # of pieces in underfull sequences
        self.having: dict[int, dict[int, None]] = {}  # their places by length, in order
        self.emptiest: list[tuple[int, int]] = []
        for b in range(len(bins)):
            self._open(b)

    def _open(self, b: int) -> None:
        if 0 < self.fill[b] < self.cap:
            heapq.heappush(self.emptiest, (self.fill[b], b))
            for i in sorted(self.bins[b]):
                self.at[i] = b
                self.having.setdefault(self.lengths[i], {})[i] = None

    def _close(self, b: int) -> None:
        for i in self.bins[b]:
            if self.at.pop(i, None) is not None:
                del self.having[self.lengths[i]][i]

    def _swap(self, b: int, out: tuple[int, ...], a: int, into: tuple[int, ...]) -> bool:
        """``into`` goes from a to b and ``out`` from b to a."""
        self._close(a)
        self._close(b)
        self.bins[b] = (self.bins[b] - set(out)) | set(into)
        self.bins[a] = (self.bins[a] - set(into)) | set(out)
        gain = sum(self.lengths[i] for i in into) - sum(self.lengths[i] for i in out)
        self.fill[b] += gain
        self.fill[a] -= gain
        self.live -= self.fill[a] == 0
        self._open(a)
        self._open(b)
        return True

    def _sums(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """One piece for each length in b, and one pair for each sum of two."""
        ones: dict[int, tuple[int, ...]] = {}
        twice: dict[int, tuple[int, ...]] = {}
        for i in sorted(self.bins[b]):
            n = self.lengths[i]
            if n in ones:
                twice.setdefault(2 * n, (*ones[n], i))
            ones.setdefault(n, (i,))
        known = list(ones.items())
        for k, (n, i) in enumerate(known):
            for m, j in known[:k]:
                twice.setdefault(n + m, (*i, *j))
        return ones, twice

    def _emptiest(self, b: int) -> int | None:
        """The emptiest underfull sequence but b."""
        mine = None
        while self.emptiest:
            f, a = self.emptiest[0]
            if a == b and f == self.fill[a]:
                mine = heapq.heappop(self.emptiest)
            elif f != self.fill[a] or not 0 < f < self.cap:
                heapq.heappop(self.emptiest)
            else:
                break
        found = self.emptiest[0][1] if self.emptiest else None
        if mine:
            heapq.heappush(self.emptiest, mine)
        return found

    def improve(self, b: int) -> bool:
        """One move or exchange that fills b and raises the sum of squares: one that fills it whole if there is one, else the largest with the emptiest sequence."""
        room = self.cap - self.fill[b]
        ones, twice = self._sums(b)
        out = {0: (), **twice, **ones}
        for w, pieces_ in out.items():
            for i in self.having.get(w + room, ()):
                if self.at[i] != b:
                    return self._swap(b, pieces_, self.at[i], (i,))
        a = self._emptiest(b)
        if a is None or self.fill[a] > self.fill[b]:
            return False
        theirs, pairs = self._sums(a)
        best, choice = 0, None
        for source, leaving in ((theirs, out), (pairs, {0: (), **ones})):
            weights = sorted(leaving)
            for n, into in source.items():
                k = bisect_left(weights, n - room)
                if k < len(weights) and best < n - weights[k] <= room:
                    best, choice = n - weights[k], (leaving[weights[k]], into)
        return choice is not None and self._swap(b, choice[0], a, choice[1])

    def run(self, sweeps: int = SWEEPS) -> list[list[int]]:
        for _ in range(sweeps):
            if self.live <= self.least:
                break
            changed = False
            for b in sorted(set(self.at.values()), key=lambda b: (-self.fill[b], b)):
                while self.live > self.least and 0 < self.fill[b] < self.cap and self.improve(b):
                    changed = True
            if not changed:
                break
        return [sorted(b) for b in self.bins if b]


def pack_lengths(lengths: list[int], cap: int = CAP, sweeps: int = SWEEPS) -> list[list[int]]:
    """Places of ``lengths``, which fall, by sequence."""
    return Exchange(lengths, best_fit(lengths, cap), cap).run(sweeps)


def _placed(group: pa.Table, cap: int, left: int) -> pa.Table:
    """``group``, whose lengths fall, with ``sequence_id``, ``offset`` and whether the piece goes to the next round."""
    lengths, names = group.column("length").to_pylist(), group.column("number").to_numpy()
    bins = pack_lengths(lengths, cap)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
    size = np.fromiter(map(len, bins), np.int64, len(bins))
    n = np.asarray(lengths)[order]
    fill = np.add.reduceat(n, np.cumsum(size) - size)
    offset = np.cumsum(n) - n - np.repeat(np.cumsum(fill) - fill, size)
    again = np.zeros(len(bins), bool)
    again[np.argsort(fill, kind="stable")[:left]] = True
    again &= fill < cap
    out = group.take(pa.array(order))
    return out.append_column("sequence_id", pa.array(np.repeat(names[order][np.cumsum(size) - size], size))).append_column("offset", pa.array(offset)).append_column("again", pa.array(np.repeat(again, size)))


def _round(rows: DataFrame, groups: int, cap: int) -> DataFrame:
    """``rows`` packed by groups and written; with one group, no piece goes on."""
    parts = max(1, min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    dealt = dealt.withColumn("part", (F.col("group") % parts).cast("int")).repartitionById(parts, "part").drop("part").sortWithinPartitions("group", F.desc("length"), "number")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def placed() -> list[pa.RecordBatch]:
            return _placed(pa.Table.from_batches(held).combine_chunks(), cap, 0 if groups == 1 else LEFT).to_batches() if held else []

        for batch in batches:
            of = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo and of[lo] != now:
                    yield from placed()
                    now, held = of[lo], []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo).select(names))
        yield from placed()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long, again boolean"
    return written(dealt.transform(in_arrow, run, schema))


def pack_pieces(rows: DataFrame, cap: int = CAP, group_size: int = GROUP) -> DataFrame:
    """``rows`` (written, with a ``length`` of 1 to ``cap`` and a ``number`` of its own each) with ``sequence_id`` and ``offset``."""
    out = rows.where(F.col("length") == cap).withColumns({"sequence_id": F.col("number"), "offset": F.lit(0).cast("long")})
    rest = rows.where(F.col("length") < cap)
    most = None
    while n := rest.count():
        groups = -(-n // group_size) if most is None else min(-(-n // group_size), most)
        placed = _round(rest, groups, cap)
        out = out.unionByName(placed.where("NOT again").drop("again"))
        if groups == 1:
            break
        most = groups // 2
        rest = placed.where("again").select(rows.columns)
    return out


def pack(docs: DataFrame, tokenizer: str, cap: int = CAP, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document (PIECE's columns) with its sequence and its place there."""
    rows = written(pieces(docs, tokenizer, cap, end_id, with_ids).withColumn("number", F.monotonically_increasing_id()))
    return pack_pieces(rows, cap).drop("number")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces that were packed with their ids; a sequence is one row of at most ``cap`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
