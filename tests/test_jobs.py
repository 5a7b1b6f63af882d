"""Rules of the text functions and jobs on literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerloom.functions import text as T
from layerloom.jobs.queries import QUERIES, _vectors
from layerloom.operators import packing, layers, retrieval


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("", ""), ("a line here\n\n\nnext line", "a line here\n\nnext line"), ("first part\nPage 3 of 12\nsecond part", "first part second part"), ("some words\n# Heading\nmore words", "some words\n\n# Heading more words"), ("© 2020 all\nabc\nkept text", "kept text"), ("he said\n**Ann:** hello there\nBob: well then", "he said\n\n**Ann:** hello there\n\nBob: well then")])
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean("text")) == want


@pytest.mark.parametrize("raw, want", [("05.03.2024", "2024-03-05"), ("2024-3-5", "2024-03-05"), ("03/05/2024", "2024-03-05"), ("31.02.2024", None), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    got = one(spark, raw, T.parse_date("text"))
    assert (str(got) if got else None) == want


def test_header(spark):
    h = one(spark, "Title: A: b\nGuest: G\nTitle: last\nDate: 2024-03-05\n───\n\nbody\nhere", T.header("text"))
    assert (h.title, h.guest, str(h.date), h.body, h.has_header) == ("last", "G", "2024-03-05", "body\nhere", True)
    assert one(spark, "Title: x\nEpisode: 4\n\nbody", T.header("text")).body == "body"
    assert not one(spark, "no header", T.header("text")).has_header


def test_spans(spark):
    row = spark.createDataFrame([("One. Two is here! Three", 5, 8)], "text string, a int, b int")
    lo, hi = T.sentence_bounds(F.col("text"), F.col("a"), F.col("b"))
    assert tuple(row.select(lo, hi).first()) == (5, 18)
    assert tuple(row.select(*T.highlight_parts(F.col("text"), F.col("a"), F.col("b"))).first()) == ("One. ", "Two", " is here! Three")


def test_passages_equal_a_greedy_loop(spark):
    rng = random.Random(2)
    texts = {i: "\n\n".join(" ".join(" ".join(["w"] * rng.randint(1, 9)) + "." for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 4))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for most, overlap in ((12, 1), (20, 2), (5, 0)):
        want = {}
        for i, t in texts.items():
            ss = [(p, s) for p, para in enumerate(t.split("\n\n")) for s in para.replace(". ", ".|").split("|") if s]
            n, s, out = [len(x.split()) for _, x in ss], 0, []
            while s < len(ss):
                e, total = s + 1, n[s]
                while e < len(ss) and total + n[e] <= most:
                    total += n[e]
                    e += 1
                out.append("".join(("" if k == s else " " if ss[k][0] == ss[k - 1][0] else "\n\n") + ss[k][1] for k in range(s, e)))
                if e == len(ss):
                    break
                s = max(e - overlap, s + 1)
            want |= {(i, k): c for k, c in enumerate(out)}
        got = {(r.episode_id, r.passage_index): r.content for r in packing.passage(docs, max_tokens=most, overlap=overlap).collect()}
        assert got == want


def test_lookback_golden_counts(spark):
    """Known totals of a run: 32 flagged in 5 calls, 30 resolved, 2 left."""
    calls = {3: (1, 1), 4: (17, 0), 6: (6, 1), 7: (3, 0), 8: (3, 0)}
    rows = [(f"{c}:propositions:{i}", c, 42, "x", i >= done) for c, (done, left) in calls.items() for i in range(done + left)]
    r = layers.lookback_summary(spark.createDataFrame(rows, "item_id string, passage_id long, episode_id long, content string, needs_lookback boolean")).first()
    assert (r.flagged, r.calls, r.resolved, r.still_unresolved) == (32, 5, 30, "3:propositions:1,6:propositions:6")


def test_every_twentieth_row_is_a_query_in_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((130, 6)).round(3)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = set()
    for q in range(0, 130, 20):
        d = 1 - unit @ unit[q]
        for k, layer in enumerate(("chunk", "proposition", "claim", "phrase")):
            near = sorted((d[i], i) for i in range(k, 130, 4) if d[i] <= (0.75 if layer == "phrase" else 0.8))[:20]
            want |= {(q, layer, i) for _, i in near}
    key = lambda rows: {(r.query_id, r.layer, r.id) for r in rows}
    assert key(QUERIES["topk_layers_all"](spark, str(tmp_path)).collect()) == want
    items = _vectors(spark, str(tmp_path))
    asked = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = retrieval.layer_hits(items, asked, 0.20, 0.25, block_bytes=150).collect()
    assert key(got) == want and len(got) == len(want)


def test_blocks_of_queries_grow_instead_of_their_number(spark):
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    blocks = list(retrieval.query_blocks(asked, 150))
    assert 1 < len(blocks) == blocks[0][0] <= 4
    assert sorted(i for _, b in blocks for i in b.column("query_id").to_pylist()) == list(range(400))


def test_the_entry_can_be_asked_again():
    import __spark_entry__ as entry

    first, sql = entry.queries(), entry.oracle_sql()
    assert set(entry.queries()) == set(first) and entry.oracle_sql() == sql and set(sql) <= set(first) and len(sql) > 70
