"""Titles, joins, stored layers, search results and ordered look-back on literal rows and against plain loops."""

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerloom.functions import text as T
from layerloom.operators import episodes, layers, replies


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("he said so\nPlan B\nand went", "he said so Plan B and went"),  # one letter is no word of a title
    ("he said so\nBig   Title\nand went", "he said so\n\nBig   Title and went"),
    ("some \u0001 marks\nand \u0002 more", "some \u0001 marks and \u0002 more"),
    ("\n\n\nfirst words\n\n\n\nlast words\n\n", "first words\n\nlast words"),
    ("A Title Of Three Words\nbody text", "A Title Of Three Words body text"),
    ("One Two Three\nfour five", "One Two Three four five"),
])
def test_clean_lines(spark, raw, want):
    assert one(spark, raw, T.clean("text")) == want


@pytest.mark.parametrize("raw, want", [
    ("# Head\n\ntext **bold** and *thin* `code` __low__", "Head\n\ntext bold and thin code low"),
    ("It ends. Big Title Here and on. Ann: hello", "It ends.\n\nBig Title Here and on.\n\nAnn: hello"),
    ("one ## two", "one\n\ntwo"), ("a **b **c** d** e", "a b c d e"), ("", ""),
])
def test_strip_markdown(spark, raw, want):
    assert one(spark, raw, T.strip_markdown("text")).replace("**", "") == want


@pytest.mark.parametrize("raw, want", [("a\nb\n\nc", ["a b", "c"]), ("a\nBig Title\nb", ["a", "Big Title", "b"]), ("Big Title\nb", ["Big Title b"]), ("x\nAnn: hi\nBob: yo", ["x", "Ann: hi", "Bob: yo"]), ("", [""]), (" \n ", [" \n "])])
def test_display_blocks(spark, raw, want):
    assert one(spark, raw, T.display_blocks("text")) == want


@pytest.mark.parametrize("a, b, want", [("x. ", " Y", "x.\n\nY"), ("x", "Y", "x Y"), ("x!", "# y", "x!\n\n# y"), ("x?", "y", "x? y"), ("", " y", "y"), ("x ", "", "x"), ("x.", "Él", "x.\n\nÉl"), ("x.", "**A:** b", "x.\n\n**A:** b")])
def test_joined(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.joined_passages(F.col("a"), F.col("b")).alias("x")).first().x == want


def test_highlights(spark):
    rows = spark.createDataFrame([(0, 0, 9), (3, 3, 9), (-1, 4, 9), (2, 10, 9), (2, 9, 9), (None, 4, 9), (1, 2, 9)], "a int, b int, n int")
    assert [r.x for r in rows.select(T.valid_highlight(F.col("a"), F.col("b"), F.col("n")).alias("x")).collect()] == [False, False, False, False, True, False, True]


def test_diff_with_null_sources(spark):
    make = lambda rows: spark.createDataFrame([(1, "claim", i, *r) for i, r in enumerate(rows)], "passage_id long, layer string, id long, content string, source_text string")
    old, new = make([("a", None), ("b", None), ("c", "x"), (" d\t", "y")]), make([("a", None), ("b", "z"), ("e", None), ("d", "y")])
    assert {r.key: r.change for r in layers.model_diff(old, new).collect()} == {"a": "unchanged", "b": "source_span_changed", "c": "removed", "d": "unchanged", "e": "added"}


def test_fuzzy_items_in_curly_text(spark):
    passage = "They said “it’s a — long… story” to us all."
    items = [(1, "claim", 0, "c", "said \"it's a - long... storey\"", False), (1, "claim", 1, "c", "nothing of the kind here", False), (2, "claim", 0, "c", "they", False)]
    rows = spark.createDataFrame(items, "passage_id long, layer string, p long, content string, source_text string, needs_lookback boolean")
    found = replies.resolve_spans(rows, spark.createDataFrame([(1, passage), (2, "")], "id long, content string"))
    kept, counts = replies.placed(found)
    got = kept.collect()
    assert len(got) == 1 and "long" in got[0].source_text and passage[got[0].start_char : got[0].end_char] == got[0].source_text
    assert {r.passage_id: (r.kept, r.dropped) for r in counts.collect()} == {1: (1, 1), 2: (0, 1)}


def test_lookback_answers(spark):
    raw = ['{"resolved": [{"item_id": "1:claims:0", "content": "x"}, {"item_id": "1:claims:0", "content": "y"}, 5, {"content": "z"}]}', "no json", '{"other": 1}', "[1]", None]
    got = replies.lookback_answers(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [(r.item_id, r.reply) for r in got] == [("1:claims:0", "y")]


def test_persist_and_clear(spark):
    passages = spark.createDataFrame([(1, 7, 0, None, None), (2, 7, 1, None, "old"), (3, 8, 0, None, None)], "id long, episode_id long, passage_index long, extracted_at timestamp, extraction_model string")
    item = lambda c, p, t: (c, "claim", p, t, t, 0, 1, False)
    now = F.lit("2024-03-05 12:00:00").cast("timestamp")
    stored = spark.createDataFrame([item(1, 0, "a"), item(2, 0, "b"), item(2, 1, "c")], episodes.ITEM).withColumn("extraction_model", F.lit("m1")).withColumn("created_at", now)
    after, items = episodes.persist_layers(passages, stored, spark.createDataFrame([item(2, 0, "n"), item(3, 0, "k")], episodes.ITEM), "m2", now)
    assert sorted((r.passage_id, r.content, r.extraction_model) for r in items.collect()) == [(1, "a", "m1"), (2, "n", "m2"), (3, "k", "m2")]
    assert {r.id: (r.extracted_at is not None, r.extraction_model) for r in after.collect()} == {1: (False, None), 2: (True, "m2"), 3: (True, "m2")}
    cleared = episodes.clear_stamps(after, after.where("episode_id = 7").select("episode_id"))
    assert {r.id: (r.extracted_at is not None, r.extraction_model) for r in cleared.collect()} == {1: (False, None), 2: (False, None), 3: (True, "m2")}


def test_results_drop_repeated_texts(spark):
    hits = spark.createDataFrame([(0, 1, 10, "claim", 5, 0.9), (0, 2, 11, "claim", 6, 0.8), (0, 3, 12, "chunk", 12, 0.7), (1, 1, 11, "claim", 6, 0.8), (1, 2, 99, "claim", 6, 0.6)], "query_id long, place long, passage_id long, layer string, id long, similarity double")
    passages = spark.createDataFrame([(10, 1, 0, "One is here. Two follows."), (11, 2, 0, "One is here. Two follows."), (12, 3, 0, "Other\n\nblock")], "id long, episode_id long, passage_index long, content string")
    items = spark.createDataFrame([("claim", 5, "matched", 0, 3), ("claim", 6, "m", 5, 99)], "layer string, id long, content string, start_char long, end_char long")
    found = episodes.results(hits, passages, items)
    assert sorted((r.query_id, r.place, r.highlight_start) for r in found.collect()) == [(0, 1, 0), (0, 3, None), (1, 1, None)]
    got = {(r.query_id, r.place): (r.quote, r.context, r.has_highlight) for r in episodes.snippets(found).collect()}
    assert got == {(0, 1): ("One", "matched", True), (0, 3): ("Other", "block", False), (1, 1): ("One is here. Two follows.", "m", False)}


def test_ordered_lookback_against_a_loop(spark):
    rng = np.random.default_rng(3)
    passages, items = [], []
    for e in range(4):
        for k in range(6):
            passages.append((e * 10 + k, e, k, f"text {e} {k}"))
            for p in range(int(rng.integers(0, 5))):
                layer = ("proposition", "claim", "phrase")[p % 3]
                items.append((e * 10 + k, layer, p, f"{layer} {p} {'x' * int(rng.integers(1, 9))}", bool(rng.random() < 0.6)))

    def ask(prior, asked):
        if "text 2 1" in prior:
            return "not json"
        return json.dumps({"resolved": [{"item_id": x["item_id"], "content": f"{x['content']}/{len(prior)}"} for x in json.loads(asked) if len(x["content"]) % 3]})

    by = defaultdict(list)
    for i in items:
        by[i[0]].append(list(i))
    want = {}
    for e in range(4):
        sections = []
        for pid, _, k, text in (p for p in passages if p[1] == e):
            mine, place = by[pid], defaultdict(int)
            named = []
            for x in sorted(mine, key=lambda x: x[2]):
                named.append((f"{pid}:{x[1]}s:{place[x[1]]}", x))
                place[x[1]] += 1
            flags = [(n, x) for n, x in named if x[4] and x[1] != "phrase"]
            if flags:
                try:
                    new = {r["item_id"]: r["content"] for r in json.loads(ask("\n\n".join(sections[-2:]), json.dumps([{"item_id": n, "content": x[3]} for n, x in flags])))["resolved"]}
                except ValueError:
                    new = {}
                for n, x in flags:
                    if n in new:
                        x[3], x[4] = new[n], False
            said = "\n".join(f"- {x[3]}" for _, x in named if x[1] == "proposition")
            sections.append(f"[passage {k}: text]\n{text}" + (f"\n\n[passage {k}: propositions]\n{said}" if said else ""))
            want |= {n: (x[3], x[4]) for n, x in named}
    p = spark.createDataFrame(passages, "id long, episode_id long, passage_index long, content string").repartition(3)
    i = spark.createDataFrame(items, "passage_id long, layer string, p long, content string, needs_lookback boolean")
    assert {r.item_id: (r.content, r.needs_lookback) for r in episodes.ordered_lookback(p, i, ask).collect()} == want
    assert episodes.ordered_lookback(p, i.limit(0), ask).count() == 0
    many = lambda asked: [ask(*x) for x in asked]
    assert {r.item_id: (r.content, r.needs_lookback) for r in episodes.lookback_rounds(p, i, many, batch=2).collect()} == want
    assert episodes.lookback_rounds(p.limit(0), i, many).count() == 0


def test_backfill_asks_only_for_what_lacks(spark):
    rows = spark.createDataFrame([(1, "aa", [1.0, 0.0], "old"), (2, "bbb", None, None)], "id long, content string, embedding array<double>, embedding_model string").withColumn("embedded_at", F.lit(None).cast("timestamp"))

    def embed(texts):
        assert texts == ["bbb"]
        return [[3.0, 4.0]]

    got = {r.id: (r.embedding, r.embedding_model) for r in episodes.backfilled(rows, embed, "new", F.current_timestamp()).collect()}
    assert got == {1: ([1.0, 0.0], "old"), 2: ([0.6, 0.8], "new")}


def test_snippets_display_a_text_once_for_all_queries(spark, capsys):
    texts = spark.createDataFrame([(1, "e", 0, "# Head\n\nOne **two** three.\n\nMore text."), (2, "e", 1, "Just one line. " * 30)], "id long, episode_id string, passage_index int, content string")
    items = spark.createDataFrame([("claim", 7, "item 7", 8, 15)], "layer string, id long, content string, start_char long, end_char long")
    hits = spark.createDataFrame([(q, p, p, layer, 7, 0.5) for q in range(3) for p, layer in ((1, "claim"), (2, "chunk"))], "query_id long, place long, passage_id long, layer string, id long, similarity double")
    want = sorted(episodes.snippets(episodes.results(hits, texts, items)).collect())
    got = episodes.snippets(episodes.results(hits, episodes.displayed(texts), items, keep=["display"]))
    assert sorted(got.collect()) == want and len(want) == 6
    capsys.readouterr()
    got.explain()
    assert "aggregate(" not in capsys.readouterr().out  # blocks are made where the texts are, before the join
