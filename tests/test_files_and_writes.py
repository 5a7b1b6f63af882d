"""Files in and out, tables that change together, the ledger of requests, and the stream: with the failures that they stand."""

import json
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from layerloom.functions import text as T
from layerloom.operators import replies
from layerloom.operators.ledger import RequestLedger
from layerloom.sources import transcripts
from layerloom.sources.store import Conflict, Store
from layerloom.streaming.ingest import ingest_files

HEADS = ["Title: A: b\nGuest: G\nTitle: last\nDate: 2024-03-05\n───\n\nbody\nhere", "Title: x\nGuest: y\nEpisode: 4\n\nbody", "no header", "Title: \nGuest: g\n──\nb", "Title: t\nGuest:  \n──\nb", "Title: t\nGuest: g\nDate: 31.02.2024\n──\n", "Title: t\nGuest: g\nDate: 1.2.2023\nno rule", ""]


def test_headers_of_files_are_those_of_columns(spark):
    rows = spark.createDataFrame([(h,) for h in HEADS], "raw string").select("raw", T.header("raw").alias("h")).collect()
    for r in rows:
        title, guest, day, body, error = transcripts.header_fields(r.raw)
        assert (title, guest, day, body) == (r.h.title, r.h.guest, r.h.date, r.h.body), r.raw
        assert (error == "no header") == (not r.h.has_header)


def test_workers_get_small_parts_of_files_and_rows(spark, tmp_path):
    """A reading task has about 2 MB of files, and a writing one gets its rows in batches of about 2 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    transcripts.register(spark)
    assert int(spark.conf.get(name).rstrip("b")) <= 2 << 20
    for i in range(8):
        (tmp_path / f"{i}.txt").write_text(f"Title: {i}\nGuest: g\n─\n" + "x" * 1_000_000)
    df = spark.read.format("transcripts").load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4
    assert sorted((r.title, len(r.body)) for r in df.collect()) == [(str(i), 1_000_000) for i in range(8)]


def test_transcripts_are_read(spark, tmp_path):
    transcripts.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text(HEADS[0])
    (tmp_path / "sub" / "b.txt").write_text("no header")
    (tmp_path / "c.pdf").write_text(HEADS[0])
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "_hidden.txt").write_text(HEADS[0])
    df = spark.read.format("transcripts").option("groupBytes", 10).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4
    got = {r.name: (r.title, r.date, r.error) for r in df.collect()}
    assert got == {"a.txt": ("last", date(2024, 3, 5), None), "b.txt": (None, None, "no header"), "c.pdf": ("last", date(2024, 3, 5), "not a text file"), "d.txt": (None, None, "not readable: UnicodeDecodeError")}
    (tmp_path / "none").mkdir()
    assert spark.read.format("transcripts").load(str(tmp_path / "none")).count() == 0


def test_documents_are_written_all_or_none(spark, tmp_path):
    transcripts.register(spark)
    out = str(tmp_path / "out")
    rows = [(f"{transcripts.slug(t)}-{i}.json", json.dumps({"id": i, "title": t})) for i, t in enumerate(["A talk", "Ünï code!", None, "--"])]
    df = spark.createDataFrame(rows, "name string, document string").repartition(3)
    df.write.format("documents").mode("append").save(out)
    files = lambda: {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert files() == dict(rows) and set(files()) == {"a-talk-0.json", "n-code-1.json", "untitled-2.json", "untitled-3.json"}

    failing = df.withColumn("document", F.when(F.col("name") == "a-talk-0.json", F.raise_error(F.lit("stop"))).otherwise("other"))
    with pytest.raises(Exception, match="stop"):
        failing.write.format("documents").mode("append").save(out)
    assert files() == dict(rows)
    for bad in (df.unionByName(df), df.withColumn("name", F.lit("../x"))):
        with pytest.raises(Exception):
            bad.write.format("documents").mode("append").save(out)
        assert files() == dict(rows)
    df.where("name LIKE 'a-%'").withColumn("document", F.lit("new")).write.format("documents").mode("overwrite").save(out)
    assert files() == {"a-talk-0.json": "new"}


SCHEMAS = {"items": "episode_id long, passage_id long, content string", "passages": "episode_id long, passage_id long, stamp string"}


def library(spark, path, **more):
    out = Store(spark, str(path), SCHEMAS, buckets=4)
    p = spark.range(40).select((F.col("id") % 10).alias("episode_id"), F.col("id").alias("passage_id"), F.lit("").alias("stamp"))
    out.change(p.select("episode_id"), lambda now: {"items": p.select("episode_id", "passage_id", F.lit("old").alias("content")), "passages": p}, **more)
    return out


def state(lib):
    return Counter((r.episode_id, r.content) for r in lib.read("items").collect()), Counter((r.episode_id, r.stamp) for r in lib.read("passages").collect())


def test_tables_change_together(spark, tmp_path):
    lib = library(spark, tmp_path / "lib")
    before = state(lib)
    assert before == (Counter({(e, "old"): 4 for e in range(10)}), Counter({(e, ""): 4 for e in range(10)}))
    scope = spark.createDataFrame([(3,), (4,), (77,), (None,)], "episode_id long")

    def make(now):
        assert {r.episode_id for r in now["items"].collect()} <= {3, 4}
        fresh = now["items"].where("passage_id % 20 = 3").withColumn("content", F.lit("new"))
        return {"items": fresh, "passages": now["passages"].withColumn("stamp", F.lit("done"))}

    def dies(table):
        if table == "items":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        lib.change(scope, make, between=dies)
    assert state(lib) == before  # the items are written, but count for nothing
    for _ in range(2):  # again, and once more: the same rows
        lib.change(scope, make)
        items, passages = state(lib)
        assert items == Counter({(e, "old"): 4 for e in range(10) if e not in (3, 4)} | {(3, "new"): 2})
        assert passages == Counter({(e, "done" if e in (3, 4) else ""): 4 for e in range(10)})
    gone = lib.vacuum(keep=1)
    assert gone >= 2 and state(lib) == (items, passages)


def test_two_changes_from_one_manifest(spark, tmp_path):
    lib = library(spark, tmp_path / "lib")
    scope = spark.createDataFrame([(1,)], "episode_id long")
    set_to = lambda word: lambda now: {"items": now["items"].withColumn("content", F.lit(word))}
    with pytest.raises(Conflict):
        lib.change(scope, set_to("late"), between=lambda table: lib.change(scope, set_to("early")))
    assert state(lib)[0][1, "early"] == 4 and (1, "late") not in state(lib)[0]


def test_ledger_against_a_loop(spark, tmp_path):
    """Answers depend on how often a request was asked; the log of what was sent is kept in files."""
    log = tmp_path / "log"
    log.mkdir()
    needs = {i: (i % 4) + 1 for i in range(20)}  # the attempt that has a good answer

    def ask(texts):
        import os
        import uuid

        out = []
        for t in texts:
            n = sum(f.startswith(f"{t}-") for f in os.listdir(log)) + 1
            (log / f"{t}-{uuid.uuid4().hex}").write_text("")
            out.append(json.dumps({"n": n}) if n >= needs[int(t)] else ["[1]", None, "{cut"][n % 3])
        return out

    requests = spark.createDataFrame([(i, str(i)) for i in needs], "id long, request string")
    book = RequestLedger(spark, str(tmp_path / "book"))
    assert book.run(requests.where("id < 10"), ask, batch=3) == 3
    again = RequestLedger(spark, str(tmp_path / "book"))  # continues, and sends nothing twice
    assert again.run(requests, ask, batch=3) == 3 and again.run(requests, ask) == 0
    sent = Counter(int(p.name.split("-")[0]) for p in log.iterdir())
    assert sent == {i: min(n, 3) for i, n in needs.items()}
    assert {r.id: (json.loads(r.raw)["n"], r.attempt) for r in again.replies().collect()} == {i: (n, n) for i, n in needs.items() if n <= 3}
    assert {r.id: r.attempts for r in again.set_aside(requests).collect()} == {i: 3 for i, n in needs.items() if n == 4}
    attempts = again.attempts().select(F.col("id").alias("passage_id"), "attempt", "raw")
    parsed = {r.passage_id: r.attempt for r in replies.parse_replies(attempts).select("passage_id", "attempt").collect()}
    assert parsed == {i: n if n <= 3 else None for i, n in needs.items()}


def _file(title="T", body="some words here."):
    return f"Title: {title}\nGuest: G\n───\n\n{body}"


def test_stream_keeps_hashes_in_its_state(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    embed = lambda texts: [[1.0, len(t) % 3] for t in texts]

    def run():
        query = ingest_files(spark, str(inbox), str(tmp_path / "lib"), str(tmp_path / "state"), embed, 0.5)
        query.awaitTermination()
        return query

    read = lambda t: spark.read.parquet(str(tmp_path / "lib" / t))
    (inbox / "a.txt").write_text(_file())
    (inbox / "b.txt").write_text("no header")
    (inbox / "b2.txt").write_text(_file("Copy of a"))
    run()
    assert read("episodes").count() == 1
    (inbox / "c.txt").write_text(_file("Again"))
    (inbox / "d.txt").write_text(_file("New", "another text. With two sentences. " * 40))
    state = run().lastProgress or {}
    titles = sorted(r.title for r in read("episodes").collect())
    assert titles in (["New", "T"], ["Copy of a", "New"])
    assert Counter(r.reject_reason for r in read("rejected").collect()) == {"no header": 1, "duplicate": 2}
    first = read("episodes").where("title <> 'New'").first().file_id
    assert {r.duplicate_of for r in read("rejected").where("reject_reason = 'duplicate'").collect()} == {first}
    passages = read("passages")
    assert passages.where("batch = 0").count() == 1 and passages.where("batch > 0").selectExpr("sum(token_estimate)").first()[0] >= 200
    assert not state or sum(x["numRowsTotal"] for x in state["stateOperators"]) == 2  # one row for each text, whatever was copied
    # the last batch runs again after its output was written, as after a failure: the same rows
    rows = lambda: sorted(map(tuple, read("passages").collect()))
    before = rows()
    (last,) = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1:]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert rows() == before and read("episodes").count() == 2
