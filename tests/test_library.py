"""Admission, replies, spans and the stream, on small rows."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from layerloom.operators import admission, replies, status
from layerloom.streaming.ingest import ingest_files


def _file(title="T", guest="G", body="some words here."):
    return f"Title: {title}\nGuest: {guest}\n───\n\n{body}"


def test_admission_rules(spark):
    rows = [(1, "a.txt", _file()), (2, "b.pdf", _file()), (3, "c.txt", "no header"), (4, "d.txt", _file(title="")), (5, "e.txt", _file(guest=" ")), (6, "f.txt", _file("Other")), (7, "g.txt", _file(body="kept elsewhere")), (8, "h.txt", None)]
    files = spark.createDataFrame(rows, "file_id long, name string, raw string")
    stored = admission.admit(files).where("file_id = 7").select(F.lit(70).cast("long").alias("id"), "content_hash")
    got = {r.file_id: (r.reject_reason, r.duplicate_of) for r in admission.admit(files, stored).collect()}
    assert got == {1: (None, None), 2: ("not a text file", None), 3: ("no header", None), 4: ("no title", None), 5: ("no guest", None), 6: ("duplicate", 1), 7: ("duplicate", 70), 8: ("no header", None)}


def test_backfill(spark):
    rows = [(1, None, "same text"), (2, None, "same text"), (3, None, "held text"), (4, "x", "other")]
    eps = spark.createDataFrame(rows, "id long, content_hash string, text string")
    eps = eps.unionByName(eps.where("id = 3").select(F.lit(9).cast("long").alias("id"), F.sha2("text", 256).alias("content_hash"), "text"))
    assert {r.id: r.action for r in admission.backfill_hashes(eps).collect()} == {1: "updated", 2: "skipped", 3: "skipped"}


def test_merge_stops_at_the_cap_and_at_unlike_vectors(spark):
    rows = [(1, i, 100, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]])]
    got = admission.merge_neighbours(spark.createDataFrame(rows, "episode_id long, position long, tokens long, embedding array<double>"), 0.5, 250).orderBy("position").collect()
    assert [r.group_index for r in got] == [0, 0, 1, 2, 3, 4]


def test_replies(spark):
    good = {"propositions": [{"content": " a b ", "needs_lookback": "yes"}, {"content": ""}, 5, {"content": "c", "source_text": "s", "needs_lookback": 0}], "claims": {"x": "bare", "y": {"content": "d", "needs_lookback": True}}, "phrases": 7}
    rows = [(1, 1, "{bad"), (1, 2, json.dumps(good)), (1, 3, '{"claims": ["late"]}'), (2, 1, "nothing"), (3, 1, None), (4, 4, "{}")]
    parsed = replies.parse_replies(spark.createDataFrame(rows, "passage_id long, attempt int, raw string"))
    assert {r.passage_id: r.attempt for r in parsed.select("passage_id", "attempt").collect()} == {1: 2, 2: None, 3: None, 4: None}
    got = sorted((r.layer, r.content, r.source_text, r.needs_lookback) for r in replies.reply_items(parsed).collect())
    assert got == [("claim", "bare", "bare", False), ("claim", "d", "d", True), ("proposition", "a b", "a b", True), ("proposition", "c", "s", False)]


def test_spans(spark):
    passage = "The quick  brown fox (it) jumps\nover the lazy dog."
    items = [(1, "claim", i, "c", s, False) for i, s in enumerate(["quick", "quick brown", "fox (it) jumps over", "jumped over the lazy dog", "absent words altogether", "x.y"])]
    rows = spark.createDataFrame(items, "passage_id long, layer string, p long, content string, source_text string, needs_lookback boolean")
    got = {r.p: r for r in replies.resolve_spans(rows, spark.createDataFrame([(1, passage)], "id long, content string")).collect()}
    assert [got[i].source_text for i in (0, 1, 2)] == ["quick", "quick  brown", "fox (it) jumps\nover"]
    assert all(passage[r.start_char : r.end_char] == r.source_text for r in got.values() if r.start_char is not None)
    assert [got[i].start_char is None for i in range(6)] == [False, False, False, False, True, True]


@pytest.mark.parametrize("text, wanted", [("alpha beta gamma delta", "beta gamna"), ("one two three four", "zzzzzzzzzz"), ("short", "a longer text"), ("", "a longer text"), ("they said “it’s a — long…  story” to us", 'said "it\'s a - long... storey"'), ("a  b   c d e f g h", " b c d e f g x ")])
def test_window_is_the_best_of_all(text, wanted):
    n, plain = len(wanted.strip()), replies.plain
    every = [(-SequenceMatcher(None, plain(text[i : i + k]), plain(wanted)).ratio(), i, k) for i in range(len(text)) for k in range(max(8, n - 15), n + 25) if i + k <= len(text)]
    best = min(every, default=(0, 0, 0))
    assert replies.best_window(text, wanted) == ((best[1], best[1] + best[2]) if -best[0] >= 0.82 else None)


def test_requests(spark):
    got = replies.request_replies(spark.createDataFrame([(1, "ab"), (2, "c")], "id long, request string"), lambda texts: [t.upper() for t in texts], batch=1)
    assert {r.id: r.raw for r in got.collect()} == {1: "AB", 2: "C"}


def test_resolutions(spark):
    flags = spark.createDataFrame([("1:claims:0", 1, "a"), ("1:claims:1", 1, "b"), ("1:claims:2", 1, "c")], "item_id string, passage_id long, content string")
    asked = spark.createDataFrame([("1:claims:0", "set", " new "), ("1:claims:1", "delete", None), ("1:claims:2", "set", " "), ("1:claims:9", "set", "x"), ("1:phrases:0", "delete", None)], "item_id string, action string, content string")
    left, said = status.apply_resolutions(flags, asked)
    assert {r.item_id: (r.content, r.needs_lookback) for r in left.collect()} == {"1:claims:0": ("new", False), "1:claims:2": ("c", True)}
    assert {r.item_id: r.status for r in said.collect()} == {"1:claims:0": "resolved", "1:claims:1": "deleted", "1:claims:2": "empty content", "1:claims:9": "not found", "1:phrases:0": "invalid layer"}


def test_stream_admits_each_text_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: ingest_files(spark, str(inbox), str(tmp_path / "lib"), str(tmp_path / "state")).awaitTermination()
    (inbox / "a.txt").write_text(_file())
    (inbox / "b.txt").write_text("no header")
    run()
    (inbox / "c.txt").write_text(_file("Again"))
    (inbox / "d.txt").write_text(_file("New", body="another text. With two sentences."))
    run()
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "lib/episodes")).collect()) == ["New", "T"]
    assert spark.read.parquet(str(tmp_path / "lib/passages")).count() == 2


def test_admission_makes_headers_and_hashes_once(spark, capsys):
    files = spark.createDataFrame([(i, "a.txt", f"Title: a\nGuest: b\n──\ntext {i % 2}") for i in range(4)], "file_id long, name string, raw string")
    admitted = admission.admit(files)
    assert {r.file_id: r.duplicate_of for r in admitted.collect()} == {0: None, 1: None, 2: 0, 3: 1}
    capsys.readouterr()
    admitted.explain(True)
    assert "sha2" not in capsys.readouterr().out  # only the written hashes are used, twice


def test_headers_with_blanks_around_rules_and_episodes(spark):
    from layerloom.functions import text as T

    cases = [
        ("Title: 😀 a\nGuest:\u00a0b \n \u2003── \r\n\n body\n──\nmore ", ("😀 a", "b", "body\n──\nmore", True)),
        ("Title: a\nEpisode: 1\nEpisode: 2\n\t\n x", ("a", None, "x", True)),
        ("Title: a\nEpisode: 2", ("a", None, "Title: a\nEpisode: 2", True)),
        ("x\n──\ny", (None, None, "x\n──\ny", False)),
        ("Title: a\nTitle: b\n─ ─\nc", ("b", None, "Title: a\nTitle: b\n─ ─\nc", True)),
        (None, (None, None, None, False)),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string").select("i", T.header("t").alias("h")).orderBy("i").collect()
    assert [(r.h.title, r.h.guest, r.h.body, r.h.has_header) for r in rows] == [want for _, want in cases]
