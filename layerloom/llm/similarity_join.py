"""N-gram Jaccard join with a prefix tree, and the groups of documents that its links connect.

A document's set is its distinct word shingles as hashes. All sets are kept in one global order: hashes, then the
``HEAVY`` most repeated shingles of the corpus, the rarest of them first (any order gives the same links; this one keeps
passages that many documents share out of the prefixes, and among near copies of one text puts first what each of them
has changed). Two sets of enough similarity share a shingle among the first ones of both (the prefix filter).

1. One row for each class of equal sets: its smallest document, size and prefix. Copies go no further.
2. If the first shingle that two sets share stands at place i of one, they share n - i at most; that bounds the other's
   size. A class whose bound is below its own size can only meet smaller ones there and stands at its bound, the others
   stand at their sizes. So ordered, the classes that share a prefix shingle are parted where one is too small for its
   successor; a part of one is done, and the first class of a part is its leader. A class joins the groups of its
   leaders: any two classes that share a prefix shingle and have fitting sizes meet in a leader's group, and a class is
   sent once for each leader, not for each shingle. First only histograms of the sets go there: shingles counted by
   hash in some n / 4 buckets. The sum of the lesser counts bounds an intersection from above, so a class none of whose
   bounds reaches the threshold leaves the group; most that meet by chance do. The others send their texts.
3. A group stores its sets in a prefix tree of globally ordered shingles. A set walks the tree with one overlap for
   each edge, shared by all sets below it; subtrees go as soon as the overlap and what remains of both lengths cannot
   reach the threshold, or when all their sets are already connected with the walker. A group of ``COUNTED`` sets or more,
   as many near copies of one text make, counts each set's overlaps with all sets that are not connected with it at once:
   what many of them have as bits, the rest by lists of the sets that have it.
4. A group with more than ``SPLIT`` classes, or ``ELEMENTS`` shingles, is dealt into parts that all have the leader. Inside a part all pairs are
   decided. Between parts only pairs matter of which one is not connected with the leader: those classes walk the
   trees of all other parts.
5. Links, of which each part keeps a spanning forest, are joined to components by minimum labels with pointer jumps.

Cases: a null text, and one without words, has an empty set and is linked with nothing; fewer words than a shingle
make one shingle; documents with one id are one document in the result, one row for each row of the input; a null id
is smallest and comes back as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom.llm.common import blank_words, in_arrow, mixed, packed, ranges, slices, written

HEAVY = 1_000_000
HEAVY_FROM = 4
COUNTED = 64
SPLIT = 1500
ELEMENTS = 4_000_000
_LEAST = -(1 << 63)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins (one entry more)."""
    h, at = blank_words(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(at[1:], n) - np.arange(len(h))  # words from here to the end
    value = np.zeros(len(h), np.uint64)
    shift = h.copy()
    for k in range(words):
        value = mixed(value * np.uint64(0x100000001B3) + np.where(left > k, shift, np.uint64(0)) + np.uint64(1))
        shift = np.append(shift[1:], np.uint64(0))
    use = (left >= words) | ((n[doc] < words) & (left == n[doc]))
    value, doc = value[use], doc[use]
    by = np.lexsort((value, doc))
    value, doc = value[by], doc[by]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(value) else np.zeros(0, bool)
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def ordered(values: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the global order, as ascending numbers: bit 63 marks the heavy ones, with their rank, the rest is the hash (its lowest bit is lost)."""
    known, rank = heavy
    if not len(known):
        return np.sort(values >> np.uint64(1))
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.sort(np.where(known[at] == values, rank[at] | np.uint64(1 << 63), values >> np.uint64(1)))


def required(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many first elements that two sets similar enough share one of them: n - ceil(percent / 100 * n) + 1."""
    return n + (-percent * n // 100) + 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), "text")


def heavy_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles: those that tasks have seen in several documents, at most HEAVY of them, and their ranks from the rarest on. It only sets the order."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        u, n = u[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, texts in slices(batch):
                held.append(shingles(texts, words)[0])
                if sum(map(len, held)) > 4_000_000:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    seen = rows.select("text").transform(in_arrow, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_FROM)
    top = seen.orderBy(F.desc("n"), "shingle").limit(HEAVY).select("shingle").toPandas()
    values = top.shingle.to_numpy(np.int64).view(np.uint64)
    by = np.argsort(values)
    return values[by], (len(by) - 1 - by).astype(np.uint64)


def histogram(s: np.ndarray) -> bytes:
    """Numbers of elements by hash in a power of two of buckets, about four elements in each; 255 stands for all from there on."""
    buckets = 1 << min(16, max(5, int(len(s) // 4).bit_length()))
    return np.minimum(np.bincount((s >> np.uint64(24)).astype(np.int64) & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def promising(sizes: np.ndarray, histograms: list[bytes], percent: int) -> np.ndarray:
    """Which of some sets, in order of size, may be similar enough to another by their histograms."""
    out = np.zeros(len(sizes), bool)
    folded: dict[int, list[np.ndarray]] = {}
    last = np.searchsorted(sizes * percent, sizes * 100, side="right")  # beyond it sets are too large
    for i, h in enumerate(histograms):
        lo, hi = i + 1, int(last[i])
        if lo >= hi or (out[i] and out[lo:hi].all()):
            continue
        if len(h) not in folded:  # larger sets have as many buckets or more
            folded[len(h)] = [_folded(x, len(h)) for x in histograms]
        rows = folded[len(h)]
        others = np.stack(rows[lo:hi])
        common = np.minimum(others, rows[i]).sum(1)
        full = ((others == 255) & (rows[i] == 255)).any(1)
        near = full | (common >= required(int(sizes[i]), sizes[lo:hi], percent))
        out[lo:hi] |= near
        out[i] |= near.any()
    return out


def _folded(h: bytes, buckets: int) -> np.ndarray:
    x = np.frombuffer(h, np.uint8)
    return np.minimum(x.reshape(-1, buckets).sum(0), 255).astype(np.int32) if len(x) > buckets else x.astype(np.int32)


class PrefixTree:
    """Sets in lexicographic order; neighbours share the edge up to their common prefix. An edge is a run of elements of the first set that has it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.begin, self.end, self.owner, self.children, self.leaf = [0], [0], [-1], [[]], [[]]
        path = [0]
        prev = None
        for i in order:
            s = sets[i]
            common = 0 if prev is None else _common(prev, s)
            while self.end[path[-1]] > common:
                node = path.pop()
                if self.begin[node] < common:  # the edge parts inside
                    top = self._new(self.begin[node], common, self.owner[node])
                    self.begin[node] = common
                    self.children[path[-1]][-1] = top
                    self.children[top].append(node)
                    path.append(top)
            if common < len(s):
                node = self._new(common, len(s), i)
                self.children[path[-1]].append(node)
                path.append(node)
            self.leaf[path[-1]].append(i)
            prev = s
        n = len(self.begin)
        self.least, self.most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        self.flat: list[int] = []
        self.span = np.zeros((n, 2), np.int64)
        self._fill()

    def _new(self, begin: int, end: int, owner: int) -> int:
        for x, v in ((self.begin, begin), (self.end, end), (self.owner, owner), (self.children, []), (self.leaf, [])):
            x.append(v)
        return len(self.begin) - 1

    def _fill(self) -> None:
        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                self.span[node, 0] = len(self.flat)
                self.flat += self.leaf[node]
                stack.append((node, True))
                stack += [(c, False) for c in reversed(self.children[node])]
                continue
            self.span[node, 1] = len(self.flat)
            sizes = [len(self.sets[i]) for i in self.leaf[node]]
            self.least[node] = min(sizes + [self.least[c] for c in self.children[node]], default=1 << 60)
            self.most[node] = max(sizes + [self.most[c] for c in self.children[node]], default=0)
        self.flat = np.array(self.flat, np.int64)

    def walk(self, s: np.ndarray, percent: int, group: np.ndarray, own: int) -> Iterator[int]:
        """Sets with enough overlap with ``s``, but for those whose ``group`` is ``own`` by now; the caller may change ``group``."""
        n = len(s)
        stack = [(0, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            lo, hi = self.span[node]
            if (group[self.flat[lo:hi]] == own[0]).all():
                continue
            edge = self.sets[self.owner[node]][self.begin[node] : self.end[node]] if node else s[:0]
            reach = required(n, self.least[node], percent)  # what the smallest set below needs
            depth, step = self.begin[node], len(edge) // 8 + 8
            for piece in (edge[:step], edge[step:]):  # the first piece often decides already
                if len(piece):
                    at = np.searchsorted(s, piece)
                    overlap += int((s[np.minimum(at, n - 1)] == piece).sum())
                    used = int(np.searchsorted(s, piece[-1], side="right"))  # elements of s up to here are decided
                    depth += len(piece)
                short = overlap + min(n - used, self.most[node] - depth) < reach
                if short:
                    break
            if short:
                continue
            for i in self.leaf[node]:
                if group[i] != own[0] and overlap >= required(n, len(self.sets[i]), percent):
                    yield i
            stack += [(c, overlap, used) for c in self.children[node]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def connect(sets: list[np.ndarray], percent: int, walkers: list[int] | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets`` (of the walkers with all others, if given). ``group``: sets that are connected already."""
    group = np.arange(len(sets)) if group is None else group
    if len(sets) >= COUNTED:
        return _counted(sets, percent, walkers, group)
    tree = PrefixTree(sets)
    links = []
    for i in walkers if walkers is not None else range(len(sets)):
        own = [group[i]]
        for j in tree.walk(sets[i], percent, group, own):
            links.append((i, j))
            group[group == group[j]] = own[0]
    return links


def _counted(sets: list[np.ndarray], percent: int, walkers: list[int] | None, group: np.ndarray) -> list[tuple[int, int]]:
    """``connect`` by overlaps with many sets at once; elements that only one set has count nowhere."""
    m = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes, group = np.array([len(sets[i]) for i in order]), group[order]
    every = np.sort(np.concatenate(sets))
    begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))[: len(every)])
    count = np.diff(np.append(begin, len(every)))
    value, count = every[begin[count > 1]], count[count > 1]
    del every
    if not len(value):
        return []
    often = 16 * count > m
    column = np.cumsum(often) - 1
    bits = np.zeros((-(-int(often.sum()) // 64), m), np.uint64)
    rare = []
    for k, i in enumerate(order):
        at = np.minimum(np.searchsorted(value, sets[i]), len(value) - 1)
        at = at[value[at] == sets[i]]
        row = np.zeros(64 * len(bits), bool)
        row[column[at[often[at]]]] = True
        bits[:, k] = np.packbits(row, bitorder="little").view(np.uint64)
        rare.append(at[~often[at]].astype(np.int32))
    whose = np.repeat(np.arange(m, dtype=np.int32), list(map(len, rare)))
    whose = whose[np.argsort(np.concatenate(rare), kind="stable")]  # the sets of each rare element, one element after the other
    count = np.where(often, 0, count)
    start = np.cumsum(count) - count
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    links = []
    for k in range(m) if walkers is None else place[walkers].tolist():
        lo = k + 1 if walkers is None else int(np.searchsorted(sizes * 100, sizes[k] * percent))
        hi = int(np.searchsorted(sizes * percent, sizes[k] * 100, side="right"))
        others = lo + np.flatnonzero(group[lo:hi] != group[k])
        if not len(others):
            continue
        some = bits[:, others] if 2 * len(others) < hi - lo else bits[:, lo:hi]
        common = np.bitwise_count(some & bits[:, k : k + 1]).sum(0, dtype=np.int64)
        common = common if len(common) == len(others) else common[others - lo]
        if len(rare[k]):
            common += np.bincount(whose[ranges(start[rare[k]], count[rare[k]])], minlength=m)[others]
        near = others[common >= required(int(sizes[k]), sizes[others], percent)]
        met, first = np.unique(group[near], return_index=True)
        if len(met):
            links += [(int(order[k]), int(order[j])) for j in near[first]]
            group[np.isin(group, met)] = group[k]
    return links


def meeting(classes: DataFrame, percent: int) -> DataFrame:
    """(class_id, n, leader): the groups that a class joins, for any two classes that may be similar enough a common one."""
    posted = classes.select("class_id", F.col("n").cast("long").alias("n"), F.posexplode("prefix").alias("place", "shingle"))
    # size and place travel as one number
    posted = posted.select("class_id", "shingle", F.shiftleft("n", 32).bitwiseOR(F.col("place")).alias("at")).repartition("shingle")
    posted = posted.select("class_id", "shingle", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))
    most = F.expr(f"CAST({100 + percent} * (n - place) DIV {percent} - n AS INT)")  # elements of a set whose first common one is this
    posted = posted.select("class_id", "n", "shingle", F.least(most, "n").alias("stand"), (most < F.col("n")).alias("probe"))
    by_size = Window.partitionBy("shingle").orderBy("stand", "probe", "n", "class_id")
    before = F.last(F.when(~F.col("probe"), F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    posted = posted.withColumn("after", F.coalesce(100 * before.cast("long") >= percent * F.col("n").cast("long"), F.lit(False))).where("after OR NOT probe")
    head = F.last(F.when(~F.col("after"), F.col("class_id")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    posted = posted.withColumn("leader", head).withColumn("before", F.coalesce(F.lead("after").over(by_size), F.lit(False)))
    return posted.where("after OR before").select("class_id", "n", "leader").distinct()


def links(docs: DataFrame, words: int = 3, percent: int = 90, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id) for each row and (a, b) links between classes that connect what is similar."""
    spark = docs.sparkSession
    rows = _keyed(docs)
    heavy = spark.sparkContext.broadcast(heavy_shingles(rows, words))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                v, at = shingles(texts, words)
                a, b, n, prefix, counts = [], [], [], [], []
                for i in range(len(texts)):
                    s = v[at[i] : at[i + 1]]
                    n.append(len(s))
                    a.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    counts.append(histogram(s))
                    prefix.append(ordered(s, heavy.value)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(counts, pa.binary())], ["doc_id", "n", "a", "b", "prefix", "histogram"])

    sketches = written(rows.transform(in_arrow, sketch, "doc_id long, n long, a long, b long, prefix array<long>, histogram binary"))
    classes = sketches.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("class_id"), F.first("prefix").alias("prefix"), F.first("histogram").alias("histogram"))
    members = sketches.select("doc_id", "n", "a", "b").join(classes.select("n", "a", "b", "class_id"), ["n", "a", "b"], "left")
    members = members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))

    sent = written(meeting(classes, percent))
    parts = F.ceil(F.greatest(F.count("*") / split, F.sum("n") / ELEMENTS)).cast("int")
    sizes = sent.groupBy("leader").agg(parts.alias("parts"))
    joined = sent.join(sizes, "leader")
    part = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    # the leader stands in all parts of its group
    in_parts = F.when(F.col("class_id") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    large = joined.where("parts > 1").select("class_id", "leader", "parts", in_parts.alias("in_parts"))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of a group that may have a link there."""
        for lead, ids, n, histograms in _grouped(batches, ["leader"], ["class_id", "n", "histogram"]):
            stay = promising(np.array(n, np.int64), histograms, percent)
            some = [i for i, s in zip(ids, stay.tolist()) if s]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([lead[0]] * len(some), pa.int64())], ["class_id", "leader"])

    small = joined.where("parts = 1").select("class_id", "leader").join(classes.select("class_id", F.col("n").cast("int").alias("n"), "histogram"), "class_id")
    small = small.repartition("leader").sortWithinPartitions("leader", "n", "class_id").select("leader", "class_id", "n", "histogram").transform(in_arrow, sifted, "class_id long, leader long")
    dealt = written(small.select("class_id", "leader", F.lit(1).alias("parts"), F.array(F.lit(0)).alias("in_parts")).unionByName(large))
    texts = packed(rows.withColumnRenamed("doc_id", "class_id"))

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead, no), ids, bodies, _ in _grouped(batches, ["leader", "part"], ["class_id", "body", "walks"]):
            found = connect(_sets(bodies, words, heavy.value), percent)
            far = _apart(len(ids), found, ids.index(lead) if lead in ids else 0)
            yield _linked([ids[i] for i, _ in found], [ids[j] for _, j in found], [False] * len(found), lead, no)
            yield _linked([ids[i] for i in far], [ids[i] for i in far], [True] * len(far), lead, no)

    first = written(_shipped(texts, dealt, F.lit(False)).transform(in_arrow, connected, _FOUND))
    pairs = first.where("NOT apart").select("a", "b")
    big = sizes.where("parts > 1")
    apart = first.where("apart").select(F.col("a").alias("class_id"), "leader").join(big, "leader").distinct()
    if apart.isEmpty():
        return members, pairs

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes that are not connected with their large group's leader against those in all of its parts."""
        for (lead, no), ids, bodies, walks in _grouped(batches, ["leader", "part"], ["class_id", "body", "walks"]):
            found = connect(_sets(bodies, words, heavy.value), percent, walkers=np.flatnonzero(walks).tolist())
            yield _linked([ids[i] for i, _ in found], [ids[j] for _, j in found], [False] * len(found), lead, no)

    walking = apart.withColumn("in_parts", F.sequence(F.lit(0), F.col("parts") - 1)).withColumn("walks", F.lit(True))
    standing = dealt.join(apart.select("leader").distinct(), "leader", "left_semi").withColumn("walks", F.lit(False))
    both = walking.unionByName(standing.select(walking.columns))
    return members, pairs.unionByName(_shipped(texts, both, F.col("walks")).transform(in_arrow, across, _FOUND).select("a", "b"))


_FOUND = "a long, b long, apart boolean, leader long, part int"


def _shipped(texts: DataFrame, dealt: DataFrame, walks: Column) -> DataFrame:
    """(leader, part, class_id, walks, body) for all parts that a class goes to, whole parts together in order."""
    to = dealt.groupBy("class_id").agg(F.collect_list(F.struct("leader", "in_parts", walks.alias("walks"))).alias("to"))
    each = texts.join(to, "class_id").select("class_id", "body", F.explode("to").alias("t")).select(F.col("t.leader").alias("leader"), F.explode("t.in_parts").alias("part"), "class_id", F.col("t.walks").alias("walks"), "body")
    return each.repartition("leader", "part").sortWithinPartitions("leader", "part", "class_id", "walks")


def _sets(bodies: list[bytes], words: int, heavy: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, texts in slices(pa.RecordBatch.from_arrays([pa.array(bodies, pa.large_binary())], ["body"]), "body"):
        v, at = shingles(texts, words)
        out += [ordered(v[at[i] : at[i + 1]], heavy) for i in range(len(texts))]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[tuple]:
    """(key, list of each column) of each group of more than one row; the batches stand in order of the key."""
    key, held = None, [[] for _ in columns]
    for b in batches:
        for k, *row in zip(zip(*(b.column(x).to_pylist() for x in by)), *(b.column(x).to_pylist() for x in columns)):
            if k != key:
                if len(held[0]) > 1:
                    yield key, *held
                key, held = k, [[] for _ in columns]
            for x, v in zip(held, row):
                x.append(v)
    if len(held[0]) > 1:
        yield key, *held


def _apart(n: int, found: list[tuple[int, int]], leader: int) -> list[int]:
    """Those of 0..n-1 that the links do not connect with ``leader``."""
    label = np.arange(n)
    for i, j in found:
        label[label == label[j]] = label[i]
    return np.flatnonzero(label != label[leader]).tolist()


def _linked(a: list, b: list, apart: list, leader: int, part: int) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(apart, pa.bool_()), pa.array([leader] * n, pa.int64()), pa.array([part] * n, pa.int32())], ["a", "b", "apart", "leader", "part"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of all ids with an edge: the smallest id reachable. Edges shrink onto roots each round, so chains of any length take few."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    while True:
        # each id's edges to its smallest neighbour: the others hang on that (large star), then the smaller ends meet (small star)
        both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionByName(edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        large = large.where("lo <> hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select("hi", "lo", "m")
        after = small.select(F.col("m").alias("lo"), F.col("hi")).unionByName(small.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).where("lo <> hi").distinct()
        after = written(after)
        if _digest(after) == _digest(edges):
            return after.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
        edges = after


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("lo", "hi")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def groups(docs: DataFrame, words: int = 3, percent: int = 90, split: int = SPLIT) -> DataFrame:
    """Per row: the size of its set and the smallest document that links reach from it."""
    members, pairs = links(docs, words, percent, split)
    found = components(pairs).withColumnRenamed("id", "class_id")
    # equal sets are linked too: a class's smallest document stands for it; documents with one id are one
    out = members.join(found, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))
    known = lambda c: F.when(F.col(c) != _LEAST, F.col(c)).alias(c)
    return out.select(known("doc_id"), "n_shingles", known("component_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all columns; documents without words all stay.

    Here a document is an id with a text: rows that share an id, or have none, but hold different texts are linked and
    kept each by its own text. Rows equal in both are one document, but for those without id and words.
    """
    text = F.col("text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    loose = (F.col("id") == _LEAST) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = keyed.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit("")))).withColumn("loose", loose)
    rows = keyed.where("NOT loose")
    found = groups(rows.select(F.col("key").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", "id", "text_hash").distinct()
    first = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "text_hash", "key")).alias("first")).select(F.col("first.key").alias("key"))
    others = F.xxhash64(*[F.col(f"row.`{c}`").cast("string") for c in docs.columns])
    place = F.row_number().over(Window.partitionBy("key").orderBy(others))
    kept = rows.join(first, "key", "left_semi").withColumn("place", place).where("place = 1")
    return kept.select("row.*").unionByName(keyed.where("loose").select("row.*"))
