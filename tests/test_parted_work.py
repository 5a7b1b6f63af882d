"""Work that is spread over tasks, against the plain loops that it stands for: merges, packing, spans and search."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerloom.operators import admission, packing, replies, retrieval
from layerloom.operators.vector_index import VectorIndex


def plain_merge(rows, threshold, cap):
    """rows: (episode, position, tokens, vector) in order."""
    out, episode = {}, None
    for e, p, n, v in rows:
        x = np.array(v, float)
        if e != episode:
            episode, group, cur, held, like = e, 0, x, n, None
        else:
            like = float(cur @ x)
            if like > threshold and held + n <= cap:
                cur = (cur + x) / 2
                cur, held = cur / (np.sqrt(cur @ cur) or 1), held + n
            else:
                group, cur, held = group + 1, x, n
        out[e, p] = (group, None if like is None else round(like, 9))
    return out


@pytest.mark.parametrize("threshold, cap, segment, head", [(0.3, 400, 64, 4), (-0.2, 100_000, 200, 3), (-2.0, 10**9, 150, 200), (0.0, 1500, 90, 1)])
def test_merge_in_segments(spark, threshold, cap, segment, head):
    rng = np.random.default_rng(4)
    rows = []
    for e, n in ((1, 260), (2, 1), (3, 40), (4, 9)):
        at = 0
        for _ in range(n):
            at += int(rng.choice([1, 1, 1, 2, 30]))
            v = rng.normal(size=4) + (0.6 if e != 3 else 0)
            rows.append((e, at, int(rng.integers(1, 200)), [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "episode_id long, position long, tokens long, embedding array<double>").repartition(5)
    got = {(r.episode_id, r.position): (r.group_index, None if r.likeness is None else round(r.likeness, 9)) for r in admission.merge_neighbours(df, threshold, cap, segment, head).collect()}
    assert got == plain_merge(rows, threshold, cap)
    assert admission.merge_neighbours(df.limit(0), threshold, cap).count() == 0


def plain_pack(sentences, most, overlap):
    out, start = [], 0
    while start < len(sentences):
        n, end = 0, start
        while end < len(sentences) and (end == start or n + len(sentences[end].split()) <= most):
            n += len(sentences[end].split())
            end += 1
        out.append(" ".join(sentences[start:end]))
        if end >= len(sentences):
            break
        start = max(end - overlap, start + 1)
    return out


def test_packing_of_long_documents(spark):
    rng = random.Random(2)
    docs = {}
    for i, n in enumerate((100_000, 700, 1, 0, 33)):
        docs[i] = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([1, 3, 8, 30, 160 if k % 50 == 0 else 5]))) + "." for k in range(n)]
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in docs.items()], "id long, text string")
    got = {(r.episode_id, r.passage_index): r.content for r in packing.passage(df, in_a_row=100).collect()}
    want = {(i, k): p for i, s in docs.items() for k, p in enumerate(plain_pack(s, 150, 1))}
    assert got == want
    some = df.where("id <> 0")
    assert {tuple(r) for r in packing.passage(some, in_a_row=100, overlap=3).collect()} == {tuple(r) for r in packing.passage(some, overlap=3).collect()}


def plain_window(text, source):
    wanted, n = replies.plain(source), len(source.strip())
    if len(wanted) < 8:
        return None
    best, at = 0.0, None
    for i in range(len(text)):
        for size in range(max(8, n - 15), min(n + 24, len(text) - i) + 1):
            got = SequenceMatcher(None, replies.plain(text[i : i + size]), wanted).ratio()
            if got > best:
                best, at = got, (i, i + size)
    return at if best >= 0.82 else None


def test_fuzzy_windows_on_random_texts():
    rng = random.Random(9)
    letters = "abcdeé .…’—\n"
    found = 0
    for k in range(60):
        words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(25)]
        text = "".join(w + rng.choice([" ", "  ", "\n", "… ", " — ", " "]) for w in words)
        a = rng.randint(0, len(text) - 30)
        source = list(text[a : a + rng.randint(9, 45)])
        for _ in range(rng.choice([0, 1, 3, 6, 20])):
            source[rng.randrange(len(source))] = rng.choice(letters)
        source = "".join(source)
        want = plain_window(text, source)
        assert replies.best_window(text, source) == want, (text, source)
        found += want is not None
    assert 15 < found < 60


def test_blanks_of_any_kind_join_words(spark):
    items = spark.createDataFrame([(1, "claim", 0, "c", "brown fox jumps", False)], "passage_id long, layer string, p long, content string, source_text string, needs_lookback boolean")
    got = replies.resolve_spans(items, spark.createDataFrame([(1, "The brown fox  jumps.")], "id long, content string")).first()
    assert (got.start_char, got.end_char, got.source_text) == (4, 20, "brown fox  jumps")


def _vectors(spark, e, layers=4):
    rows = [(i, ("chunk", "proposition", "claim", "phrase")[i % layers], i // 20, v.tolist()) for i, v in enumerate(e)]
    return spark.createDataFrame(rows, "id long, layer string, passage_id long, embedding array<double>")


def _recall(items, queries, hits, k=10):
    exact = retrieval.layer_hits(items, queries, -1.0, -1.0, k)
    key = lambda df: {(r.query_id, r.layer, r.id) for r in df.collect()}
    a, b = key(exact), key(hits)
    return len(a & b) / len(a)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_index_on_the_given_vectors(spark, tmp_path, sf):
    """These have no structure at all, so that nearly all lists are visited; codes leave few pairs to compare."""
    from layerloom.sources import tables

    items = tables.vectors(tables.table(spark, f"/root/testdata/{sf}", "embeddings"))
    queries = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex.build(items, str(tmp_path / "index"))
    compared = spark.sparkContext.accumulator(0)
    hits = VectorIndex(spark, str(tmp_path / "index")).search(queries, compared=compared).collect()
    assert _recall(items, queries, spark.createDataFrame(hits)) >= 0.9
    assert 0 < compared.value < 0.1 * items.count() * queries.count()
    assert index.probes <= len(index.centroids) and index.blocks.selectExpr("sum(n)").first()[0] == items.count()


def test_index_of_clusters(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    e = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.standard_normal((4000, 32))
    e[100:400] = e[100]  # many copies of one vector
    e[7] = 0
    items = _vectors(spark, e)
    items = items.unionByName(spark.createDataFrame([(9001, "claim", 1, None), (9002, "claim", None, [1.0, float("nan")] + [0.0] * 30), (9003, "claim", None, [1.0])], items.schema))
    queries = items.where("id % 20 = 0 AND id < 9000").select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex.build(items, str(tmp_path / "index"))
    compared = spark.sparkContext.accumulator(0)
    hits = index.search(queries, compared=compared, block_bytes=20_000)
    assert _recall(items, queries, hits) >= 0.9
    assert index.probes < len(index.centroids) / 3 and compared.value < 0.1 * 4000 * 200
    whole = index.search(queries, probes=len(index.centroids))
    assert _recall(items, queries, whole) == 1.0
    empty = VectorIndex.build(items.limit(0), str(tmp_path / "none"))
    assert empty.search(queries).count() == 0 and index.search(queries.limit(0)).count() == 0
