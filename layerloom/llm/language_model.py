"""Language-model scores by context-tree weighting over binary-decomposed bytes, with a unigram base.

A text is modelled as its tokens: A-Z lower-cased, words joined by one space, then an end byte. The eight bits of a
byte are decided one after the other; each bit's source is a context tree over the ``DEPTH`` bytes before, whose nodes
hold Krichevsky-Trofimov estimates of the bits seen there. A node's weighted probability is half its estimate and half
the product of its children's, so the score mixes the estimates of all depths by what they earned on the corpus.

1. Every executor counts the (DEPTH + 1)-byte grams of the training texts; Spark adds them up by gram.
2. Grams go by the two bytes next to the coded one to tasks that compute the subtrees from depth 2 down: the weighted
   probabilities from the deepest contexts up. The sums for the two upper levels, at most 65,535 nodes, go to the
   driver.
3. Since training is over, the mixture at a node is fixed, and so is the log probability of a gram, each bit at its
   deepest node. The tasks of step 2 give it for every gram of any text, held out or not, by the whole tree.
4. The most frequent grams, ``TABLE`` at most, are broadcast and score texts where they stand. A text's other grams
   find their log probabilities by a join, so ``TABLE`` bounds the broadcast and changes no score.

The base takes the counts of all training tokens. The ``HEAD`` most frequent words are broadcast; the rest of a
text's words find their counts by a join, which carries only rare words.

Cases: a null or empty text is the end token alone; documents with one id are scored row by row; without training
texts every count is 0, V is 0, and each byte costs 8 bits; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import crc_mod, in_arrow, ranges, slices, written

DEPTH = 5
TABLE = 500_000
HEAD = 100_000
#: The end of a text as a byte that UTF-8 has nowhere; also the context before a text.
END = 0xFF
FLUSH = 500_000
_BITS = np.arange(8)


def stream(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; all texts as bytes with DEPTH end bytes before each and one after; the coded bytes' places and texts."""
    words = [t.lower().split() for t in texts]
    lead = bytes([END]) * DEPTH
    rows = [b" ".join(w) for w in words]
    data = np.frombuffer(b"".join(x for r in rows for x in (lead, r, lead[:1])), np.uint8)
    n = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
    at = ranges(np.cumsum(n + DEPTH) - n, n)
    return words, data, at, np.repeat(np.arange(len(rows)), n)


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The coded byte and the ``depth`` bytes before it as one number: the coded byte lowest, then the nearest."""
    key = data[at].astype(np.int64)
    for d in range(1, depth + 1):
        key |= data[at - d].astype(np.int64) << (8 * d)
    return key


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments; ``x`` is positive."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(7):
        small = x < 7
        shift = np.where(small, shift - np.log(np.where(small, x, 1)), shift)
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of any sequence with so many zeros and ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def summed(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of the columns over each."""
    u, i = np.unique(key, return_inverse=True)
    return (u, *(np.bincount(i, c, len(u)) for c in cols))


def bit_nodes(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | node, zeros, ones) from gram counts: node 1 decides the highest bit, node 2n + b the next."""
    byte = key & 255
    node = (1 << _BITS) | (byte[:, None] >> (8 - _BITS))
    bit = (byte[:, None] >> (7 - _BITS)) & 1
    n = np.repeat(count, 8)
    return summed((((key >> 8) << 8)[:, None] | node).ravel(), n * (1 - bit.ravel()), n * bit.ravel())


def cut(key: np.ndarray, depth: int) -> np.ndarray:
    """Grams or nodes with the context cut to its nearest ``depth`` bytes."""
    return key & ((1 << (8 * depth + 8)) - 1)


class Levels:
    """The nodes of a part of the tree at depths ``top`` to ``deepest``: P(1) by the own estimate, and its odds against the children's."""

    def __init__(self, top: int):
        self.top, self.deepest = top, top - 1
        self.node: dict[int, np.ndarray] = {}
        self.ones: dict[int, np.ndarray] = {}
        self.odds: dict[int, np.ndarray] = {}

    def add(self, depth: int, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, kids: np.ndarray | None) -> np.ndarray:
        """Adds a depth, deepest first; ``kids`` are the sums of the children's weighted log probabilities. Returns the own ones."""
        own = estimate(n0, n1)
        self.deepest = max(self.deepest, depth)
        self.node[depth], self.ones[depth] = node, (n1 + 0.5) / (n0 + n1 + 1.0)
        if kids is None:
            return own
        self.odds[depth] = own - kids
        return np.logaddexp(own, kids) - np.log(2)

    @classmethod
    def subtrees(cls, key: np.ndarray, count: np.ndarray, top: int, deepest: int):
        """From gram counts: (levels, nodes at ``top``, their zeros, ones and weighted log probabilities)."""
        out, kids = cls(top), None
        for d in range(deepest, top - 1, -1):
            node, n0, n1 = bit_nodes(*summed(cut(key, d), count))
            weighted = out.add(d, node, n0, n1, kids)  # each node has children: a gram that counts here counts below
            kids = summed(cut(node, d - 1), weighted)[1] if d > top else None
        return out, node, n0, n1, weighted


def mixed_ones(levels: list[Levels], node: np.ndarray, depth: int) -> np.ndarray:
    """P(1) at nodes of ``depth``, mixed over all depths from there up to the root. ``levels``: deep parts first."""
    p = None
    for part in levels:
        for d in range(min(part.deepest, depth), part.top - 1, -1):
            i = np.searchsorted(part.node[d], cut(node, d))
            own = part.ones[d][i]
            if p is None:
                p = own
            else:
                share = 1 / (1 + np.exp(-np.clip(part.odds[d][i], -700, 700)))
                p = share * own + (1 - share) * p
    return p


class Slots:
    """Places of keys in an array by open addressing; -1 for keys it does not hold."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.at = np.full(1 << self.bits, -1, np.int32)
        todo, s = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = self.at[s] < 0
            self.at[s[free]] = todo[free]
            left = self.at[s] != todo
            todo, s = todo[left], (s[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        s = self._slot(keys)
        out = self.at[s]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.at[s[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


def path_logs(levels: list[Levels], key: np.ndarray, depth: int) -> np.ndarray:
    """log10 P of the coded byte of any grams of ``depth``, each bit at its deepest node of the tree. ``levels``: deep parts first."""
    byte = key & 255
    node, i = np.unique((((key >> 8) << 8)[:, None] | (1 << _BITS) | (byte[:, None] >> (8 - _BITS))).ravel(), return_inverse=True)
    p = np.full(len(node), 0.5)
    left = np.arange(len(node))
    for part in levels:
        for d in range(min(part.deepest, depth), part.top - 1, -1):
            k = cut(node[left], d)
            known = np.isin(k, part.node[d])
            p[left[known]] = mixed_ones(levels, k[known], d)
            left = left[~known]
    bit = ((byte[:, None] >> (7 - _BITS)) & 1) == 1
    q = p[i].reshape(-1, 8)
    return np.log10(np.where(bit, q, 1 - q)).sum(1)


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n) over all texts."""
    return _part_counts(docs, depth).groupBy("gram").agg(F.sum("n").alias("n"))


def _part_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n), a gram several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending: list = []
        for batch in batches:
            for _, texts in slices(batch):
                _, data, at, _ = stream(texts)
                pending.append(np.unique(grams(data, at, depth), return_counts=True))
                if sum(len(k) for k, _ in pending) > 4 * FLUSH:
                    keys, counts = _added(keys, counts, pending)
                    pending = []
                    if len(keys) > 6 * FLUSH:
                        yield _counted(keys, counts)
                        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield _counted(*_added(keys, counts, pending))

    return docs.select("text").transform(in_arrow, run, "gram long, n long")


def _added(keys, counts, pending):
    u, n = summed(np.concatenate([keys, *(k for k, _ in pending)]), np.concatenate([counts, *(c for _, c in pending)]))
    return u, n.astype(np.int64)


def _counted(keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["gram", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch):
                for t in texts:
                    held.update(t.lower().split())
                held[b""] += len(texts)  # the end token
                if len(held) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])

    return docs.select("text").transform(in_arrow, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _whole_contexts(batches: Iterator[pa.RecordBatch], size: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns, grams first, of about ``size`` grams, never parting those with one pair of nearest bytes; the batches stand in order of it."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        held.append(tuple(c.to_numpy() for c in b.columns))
        if sum(len(x[0]) for x in held) > size:
            cols = [np.concatenate(x) for x in zip(*held)]
            near = (cols[0] >> 8) & 65535
            end = int(np.flatnonzero(near != near[-1])[-1]) + 1 if (near != near[-1]).any() else 0
            if end:
                yield tuple(c[:end] for c in cols)
            held = [tuple(c[end:] for c in cols)]
    if held and sum(len(x[0]) for x in held):
        yield tuple(np.concatenate(x) for x in zip(*held))


def _dealt(counts: DataFrame) -> DataFrame:
    return counts.withColumn("near", F.expr("CAST((gram >> 8) & 65535 AS int)")).repartition("near").sortWithinPartitions("near").drop("near")


def upper_levels(counts: DataFrame, depth: int) -> Levels:
    """Depths 0 and 1 of the tree, from gram counts of depth 2 or more."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_contexts(batches):
            _, node, n0, n1, w = Levels.subtrees(key, n, 2, depth)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cut(node, 1), n0, n1, w)], ["node", "n0", "n1", "w"])

    rows = _dealt(counts.select("gram", "n")).transform(in_arrow, roots, "node long, n0 double, n1 double, w double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toPandas().sort_values("node")
    upper = Levels(0)
    node, n0, n1, kids = (rows[c].to_numpy() for c in ("node", "n0", "n1", "w"))
    weighted = upper.add(1, node.astype(np.int64), n0, n1, kids)
    node, n0, n1, kids = summed(cut(node.astype(np.int64), 0), n0, n1, weighted)
    upper.add(0, node, n0, n1, kids)
    return upper


def gram_values(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, value, total): the log10 probability of each gram. ``counts``: (gram, n, total), n in the training texts, 0 if only others have it; read twice."""
    held = counts.sparkSession.sparkContext.broadcast(upper_levels(counts.where("n > 0"), depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, total in _whole_contexts(batches):
            part = Levels.subtrees(key[n > 0], n[n > 0], 2, depth)[0]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(path_logs([part, held.value], key, depth)), pa.array(total)], ["gram", "value", "total"])

    return _dealt(counts.select("gram", "n", "total")).transform(in_arrow, run, "gram long, value double, total long")


def frequent(values: DataFrame, table: int) -> tuple[pa.Table, DataFrame]:
    """(gram, value) of the most frequent grams, ``table`` at most, and of all others."""
    step = F.floor(F.log2("total") * 8).cast("int")
    least, held = 1 << 30, 0
    for r in values.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        held += r.n
        if held > table:
            break
        least = r.step
    pairs = values.select("gram", "value")
    return pairs.where(step >= least).toArrow(), pairs.where(step < least)  # the first is bounded by the table


def _listed(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct grams of each of ``n`` texts, and how often they stand there, as lists."""
    by = np.lexsort((key, doc))
    doc, key = doc[by], key[by]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else by
    times = np.diff(np.append(first, len(key))).astype(np.int32)
    at = pa.array(np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(key[first])), pa.ListArray.from_arrays(at, pa.array(times))


def text_scores(docs: DataFrame, depth: int = DEPTH, table: int = TABLE, head: int = HEAD) -> DataFrame:
    """Per row: whether it was held out, tokens, known tokens, training tokens, the base's and the model's log10 probability, and the model's code length in bits a coded byte.

    The bytes coded are those of the words, one space between them, and the end; the first ones have end bytes as context.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = rows.where(crc_mod("doc_id", 5) != 1)
    others = rows.where(crc_mod("doc_id", 5) == 1)
    parts = _part_counts(training, depth).select("gram", "n", F.col("n").alias("total")).unionByName(_part_counts(others, depth).select("gram", F.lit(0).cast("long").alias("n"), F.col("n").alias("total")))
    counts = written(parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    often, seldom = frequent(written(gram_values(counts, depth)), table)
    model = spark.sparkContext.broadcast((Slots(often.column("gram").to_numpy()), np.append(often.column("value").to_numpy(), 0.0)))  # 0 for those not found
    del often
    words = written(word_counts(training))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("c"), "word").limit(head).select("word", "c").toArrow()
    least = top.column("c")[-1].as_py() if top.num_rows else 0
    known = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), np.log10(top.column("c").to_numpy() + 0.5).tolist())))
    rest = words.where(F.col("c") <= least)  # all that are not broadcast, and those of them with the least count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                tokens, data, at, doc = stream(texts)
                key = grams(data, at, depth)
                place = model.value[0].find(key)
                score = np.bincount(doc, model.value[1][place], len(texts))
                left = _listed(doc[place < 0], key[place < 0], len(texts))
                n_tokens, n_known, base, rare, times = [], [], [], [], []
                for w in tokens:
                    c = Counter(w)
                    c[b""] = 1
                    here = {x: k for x, k in c.items() if x in known.value}
                    n_tokens.append(len(w) + 1)
                    n_known.append(sum(here.values()))
                    base.append(sum(k * known.value[x] for x, k in here.items()))
                    rare.append([x for x in c if x not in here])
                    times.append([c[x] for x in rare[-1]])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(np.bincount(doc, minlength=len(texts))), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), *left], ["row", "doc_id", "n_tokens", "n_known", "base", "score", "n_coded", "rare", "times", "grams", "gram_times"])

    scored = written(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").transform(in_arrow, run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_coded long, rare array<binary>, times array<int>, grams array<long>, gram_times array<int>"))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    more = each.join(rest, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    each = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    more_score = each.join(seldom, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more_score"))
    total = float(np.log10(n + 0.5 * (v + 1)))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.join(more, "row", "left").join(more_score, "row", "left").select(
        "doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"), score.alias("score"),
        (-score * float(np.log2(10)) / F.col("n_coded")).alias("bits_per_byte"))
