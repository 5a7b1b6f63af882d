"""The audit of filters, the packing and the hard negatives against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from math import ceil, floor

import numpy as np
import pytest

from layerloom.llm import bin_packing, filter_audit, hard_negatives, tokens

DOCS = "doc_id long, text string, lang string, source string, part string, h string"


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)] + ["A", "BIG", "x$", "a|b", "naïve", "日本"]
    rows = []
    for i in range(70):
        n = rng.choice([0, 3, 40, 99, 100, 101, 150])
        pool = words[: rng.choice([60, 150, 156])]
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "s", "p", "h"))
    rows += [(80 + i, rows[i % 3][1], rows[i][2], None, None, None) for i in range(9)]
    rows += [(90, "UPPER CASE ONLY", "en", "s", "p", "h"), (91, None, "en", "s", "p", "h"), (92, "", "de", "s", "p", "h"), (93, " \n", None, "s", "p", "h")]
    rows += [rows[5], rows[5], (None, rows[6][1], "en", "s", "p", "h"), (None, None, None, "s", "p", "h"), (7, "another text under one id", "en", "s", "p", "h")]
    rows += [(99, " ".join(f"q{i % 90000}" for i in range(400_000)), "en", "s", "p", "h")]  # some 2.7 MB
    return rows


LABELS = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 90, 3)] + [(6, 0, 1, "x"), (None, 1, 1, "x"), (9, None, None, "x")]


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, *_ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, whole = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                before = order[: step - 1]
                redundant = sum(d[0] == part and d[1][f] and any(d[1][x] for x in before) for d in docs)
                unique = sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs)
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                whole[part, f] += len(gone)
    return {k: (*v, whole[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = corpus()
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute_audit(rows, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    without = {(r.part, r.filter_order, r.step): r.kept for r in filter_audit.audit(docs, labels.limit(0)).collect()}
    assert without == {k: v[0] for k, v in got.items()}


def test_word_totals(spark):
    rows = corpus()
    got = Counter((r.doc_id, r.n_words, r.n_distinct) for r in filter_audit.word_totals(spark.createDataFrame(rows, DOCS)).collect())
    want = Counter()
    for i, t in {(r[0], r[1] or "") for r in rows}:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want[i, len(w), len(set(w))] += 1
    assert got == want


@pytest.mark.parametrize("low, high, n, cap", [(1, 1023, 3000, 1024), (250, 520, 2000, 1024), (513, 1023, 400, 1024), (1, 9, 500, 10), (330, 345, 900, 1024), (4, 4, 7, 10)])
def test_pack_lengths(low, high, n, cap):
    rng = random.Random(n)
    lengths = sorted((rng.randint(low, high) for _ in range(n)), reverse=True)
    start = bin_packing.best_fit(lengths, cap)
    bins = bin_packing.pack_lengths(lengths, cap)
    assert sorted(i for b in bins for i in b) == list(range(n))
    assert all(0 < sum(lengths[i] for i in b) <= cap for b in bins)
    squares = lambda some: sum(sum(lengths[i] for i in b) ** 2 for b in some)
    assert len(bins) <= len(start) and (squares(bins) >= squares(start))
    least = max(ceil(sum(lengths) / cap), ceil(n / (cap // low)))
    assert len(bins) <= least * 1.08 + 1


def test_local_search_empties_a_sequence():
    """Best fit leaves four sequences where three do; one exchange sets it right."""
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]  # 30 in all
    cap = 10
    bins = [[0, 4], [1, 3], [2, 5], [6, 7]]  # 9, 9, 8, 4
    got = bin_packing.Exchange(lengths, bins, cap).run()
    assert len(got) == 3 and sorted(i for b in got for i in b) == list(range(8)) and all(sum(lengths[i] for i in b) == 10 for b in got)


def test_small_packings_are_near_the_best():
    rng = random.Random(3)

    def best(lengths, cap):
        found = len(lengths)

        def go(k, rooms):
            nonlocal found
            if len(rooms) >= found:
                return
            if k == len(lengths):
                found = len(rooms)
                return
            for r in {x for x in rooms if x >= lengths[k]}:
                left = list(rooms)
                left[left.index(r)] -= lengths[k]
                go(k + 1, left)
            go(k + 1, [*rooms, cap - lengths[k]])

        go(0, [])
        return found

    over = 0
    for _ in range(60):
        cap = 20
        lengths = sorted((rng.randint(3, 14) for _ in range(9)), reverse=True)
        over += len(bin_packing.pack_lengths(lengths, cap)) - best(lengths, cap)
    assert over <= 2


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = [(i, " ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 60, 300, 900]))), "c") for i in range(120)]
    rows += [(200, None, "c"), (None, "no id here", "c"), (5, rows[5][1], "c"), (201, "naïve text " * 250_000, "c")]  # the last has some 2.75 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    for size in (1 << 14, 40):
        written = bin_packing.written(bin_packing.pieces(docs, path, with_ids=True).withColumn("number", bin_packing.F.monotonically_increasing_id()))
        packed = bin_packing.pack_pieces(written, group_size=size)
        got = packed.collect()
        want = Counter()
        for i, t, _ in rows:
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
        for parts in held.values():
            parts.sort()
            assert [p[0] for p in parts] == list(np.cumsum([0, *(p[1] for p in parts)])[:-1]) and parts[-1][0] + parts[-1][1] <= 1024
        least = max(ceil(sum(r.length for r in got) / 1024), sum(r.length > 512 for r in got))  # no two pieces over half share a sequence
        assert len(held) <= least + (1 if size > 1000 else 3)
        made = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in bin_packing.sequences(packed).collect()}
        assert made == {k: (sum(p[1] for p in v), b"".join(p[2] for p in v)) for k, v in held.items()}
    assert bin_packing.pack(docs.limit(0), path).count() == 0


def brute_negatives(rows, every=50, positives=5, negatives=3):
    use = [(i, l, [floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    out = Counter()
    for i, l, v in {(i, l, tuple(v)) for i, l, v in use if i % every == 0}:
        scored = sorted((-dot(v, w), j, m) for j, m, w in use)
        best = [(j, -s) for s, j, m in scored if m == l and j != i][:positives]
        for p, ps in best:
            band = [(j, -s) for s, j, m in scored if m != l and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            for k, (j, s) in enumerate(band, 1):
                out[i, p, k, j, ps, s] += 1
    return out


def vectors(seed, n, dims=12, scale=0.2, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i * 2, label, [float(np.float32(x)) for x in scale * (rng.normal(size=dims) + 0.7 * centre[label] + 0.5)]))
    return rows


EMBEDDINGS = "vec_id long, label int, embedding array<float>, list string, score string"


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], EMBEDDINGS).repartition(3)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **more).collect())


@pytest.mark.parametrize("scale", [0.003, 0.2, 30.0, 2e5])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)  # several products a task
    rows = vectors(1, 500, scale=scale)
    assert (got := found(spark, rows)) == brute_negatives(rows) and (scale < 0.1 or got)


def test_hard_negatives_cases(spark):
    rows = vectors(2, 200, scale=0.2)
    one = rows[50][2]
    rows += [(1001 + k, k % 3, one) for k in range(120)]  # many equal vectors: ties by id
    rows += [(None, 1, one), (2000, None, one), (2050, 1, None), (2100, 1, [None] + one[1:]), (2150, 2, [float("nan")] + one[1:]), (2151, 2, [float("inf")] + one[1:]), (2200, 3, one[:4]), (2250, 3, []), (2300, 0, [0.0] * 12)]
    rows += [rows[25], rows[25], rows[3], (100, 2, rows[7][2])]  # repeated rows, and an anchor's id under another label
    assert found(spark, rows) == brute_negatives(rows)
    assert found(spark, rows, anchor_bytes=600) == brute_negatives(rows)
    assert found(spark, []) == Counter() and found(spark, [(1, 1, one)]) == Counter()
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, 1, [1e30, 1.0]), (1, 1, [1.0, 1.0])])
