"""Long texts, clashing columns, brute-force rules, quotas of shards, and the pipeline's stages."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from layerloom.llm import decontamination, mixing, quality, similarity_join, suffix_dedup, tokens, urls
from layerloom.llm.common import slices

WORDS = [f"w{i}" for i in range(60)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rules(pages, support, confidence, z):
    """Antecedents of tokens that stand for others, with their confidence, without those that a subset covers."""
    where = defaultdict(set)
    for i, (toks, _) in enumerate(pages):
        for t in toks:
            where[t].add(i)
    bad = {i for i, (_, b) in enumerate(pages) if b}
    base = len(bad) / len(pages)
    rank = lambda t: (len(where[t]), t)
    often = [t for t in where if len(where[t] & bad) >= max(support * len(pages), int(base * z * z / (1 - base)) + 1)]
    alike = lambda t, u: len(where[t] & where[u]) >= 0.75 * len(where[t] | where[u])
    best = {t: max([u for u in often if rank(u) > rank(t) and alike(t, u)], key=rank, default=t) for t in often}
    names = [t for t in often if best[t] == t or best[best[t]] != best[t]]
    found = {}
    for n in range(1, 6):
        for some in itertools.combinations(sorted(names), n):
            at = frozenset.intersection(*(frozenset(where[t]) for t in some))
            hit = len(at & bad)
            if hit < max(support * len(pages), 1) or hit / len(at) < confidence:
                continue
            p, m = hit / len(at), len(at)
            if (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) > base:
                found[some] = p
    return {a: c for a, c in found.items() if not any((less := a[:i] + a[i + 1 :]) in found and found[less] >= c for i in range(len(a)))}


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    schema = "tokens array<string>, bad boolean"
    pages = [([t for t in "abcdef" if rng.random() < 0.5] + ["all", "every"], False) for _ in range(160)]
    pages = [(t + ["near"] * (rng.random() < 0.9), ("a" in t and "b" in t and rng.random() < 0.9) or rng.random() < 0.2) for t, _ in pages]
    pages += [(["x", "y", f"z{i % 2}"], True) for i in range(12)]
    for z in (2.0, 3.0):
        got = urls.rules_of(spark.createDataFrame(pages, schema), 0.02, 0.6, z).collect()
        want = brute_rules(pages, 0.02, 0.6, z)
        assert {tuple(r.antecedent): pytest.approx(r.confidence) for r in got} == want and len(want) > 1
    assert ("y",) in want or ("x",) in want
    few = [(["a"], True), (["a"], True), (["b"], False), (["c"], False), (["d"], False)]
    assert urls.rules_of(spark.createDataFrame(few, schema), 0.05, 0.6).count() == 0  # two pages are no evidence
    assert urls.rules_of(spark.createDataFrame([(["a"], True)] * 9, schema), 0.05, 0.6).count() == 0  # nothing is beyond a base rate of one
    # one criterion at every size: the same pages a hundred times over have at least the same rules
    more = {tuple(r.antecedent) for r in urls.rules_of(spark.createDataFrame(pages * 100, schema), 0.02, 0.6).collect()}
    assert more >= {a for a in want if len(a) == 1}


def test_url_verdicts_miss_no_rule_of_tokens(spark):
    """Every combination of tokens that is a rule blocks, also those of tokens that stand on nearly or exactly the same pages."""
    rng = random.Random(11)
    rows = [(i, [t for t in "abcd" if rng.random() < 0.4] + ["lead", "twin"] + ["near"] * (i % 5 > 0)) for i in range(300)]
    bad = {i for i, t in rows if ("near" not in t and rng.random() < 0.9) or ("near" in t and {"a", "b"} <= set(t) and rng.random() < 0.8)}
    rows = [(i, t + ["part", "whole"] * (i in bad and i % 2)) for i, t in rows]
    # tokens on 80 pages, 54 of them bad; those nearly the same have 48 of 62: only the shorter ones may pass alone
    rows = [(i, t + ["wide"] * (i % 4 == 0 or i in bad and i % 3 == 0) + ["slim"] * (i in bad and i % 3 == 0 or i % 8 == 0)) for i, t in rows]
    asked = [(1000 + k, list(some)) for k, some in enumerate(itertools.chain.from_iterable(itertools.combinations(["a", "b", "c", "d", "lead", "near", "twin", "part", "whole", "wide", "slim"], n) for n in (1, 2, 3)))]
    pages = spark.createDataFrame([(i, f"http:///{'/'.join(t)}/{i}") for i, t in rows + asked], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    where = defaultdict(set)
    for i, t in rows:
        for x in t:
            where[x].add(i)
    base, z = len(bad) / len(rows), 3.0

    def is_rule(some):
        at = set.intersection(*(where[x] for x in some))
        hit, m = len(at & bad), len(at)
        p = hit / max(m, 1)
        return hit >= 0.02 * len(rows) and p >= 0.6 and (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) > base

    want = {i: any(is_rule(s) for n in range(1, len(t) + 1) for s in itertools.combinations(t, n)) for i, t in rows + asked}
    got = {r.page_id: r.verdict == "block" for r in urls.judge(pages, labels, support=0.02).collect()}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_verdicts_of_correlated_words_do_not_explode(spark):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}" for i in range(24)]
    rows = [(i, "/".join([w for w in words if w != words[i % 24]] + (["evil"] if i % 5 == 0 else []))) for i in range(960)]
    labels = spark.createDataFrame([(i, int(not (i % 5 == 0 or rng.random() < 0.1)), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([(i, f"http://x.info/{p}/{i}") for i, p in rows], "page_id long, url string"), labels).collect()}
    assert got == {i: "block" if i % 5 == 0 else "allow" for i, _ in rows} and time.time() - began < 60


def test_many_correlated_words_do_not_explode(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(24)]
    pages = [([w for w in words if w != words[i % 24]] + (["evil"] if i % 5 == 0 else []), i % 5 == 0 or rng.random() < 0.1) for i in range(960)]
    began = time.time()
    got = [(r.antecedent, r.confidence) for r in urls.rules_of(spark.createDataFrame(pages, "tokens array<string>, bad boolean")).collect()]
    assert (["evil"], 1.0) in got and time.time() - began < 30


def test_url_rules_of_long_common_paths_do_not_explode(spark):
    path = "/".join(f"part{i}" for i in range(40))
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site.info/{path}/{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i, _ in rows} and time.time() - began < 60  # ids from 60 on did not train


def test_shards_hold_their_quotas(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), f"s{i % 3}", "old", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard string, nth int")
    sizes = {"block_words": 64, "blocks_per_shard": 4}
    draws = [(r.k, d.block, d.shard, d.n_words) for r in mixing.plan(docs, **sizes).collect() for d in r.draws]
    words = Counter()
    for k, _, _, n in draws:
        words[k] += n
    quota = np.array([-(-words[k] // 64) for k in range(3)])
    shards = max(mixing.LEAST_SHARDS, -(-int(quota.sum()) // 4))
    tree = mixing.splitting_tree(quota, shards)
    walk = mixing.TreeWalk(quota, shards)
    assert shards > 20 and (tree.sum(0) == quota).all() and np.ptp(tree.sum(1)) <= 5
    for k in range(3):  # all blocks of a source, by the walk, fill the tree's quotas exactly
        got = walk.shard_of(np.full(quota[k], k), np.arange(quota[k]))
        assert (np.bincount(got, minlength=shards) == tree[:, k]).all()
    seen = defaultdict(set)
    for k, block, shard, _ in draws:
        seen[k, block].add(shard)
    assert all(len(s) == 1 for s in seen.values())  # a block stands in one shard
    held = {(r.shard, r.source_number): (r.n_blocks, r.n_words) for r in mixing.shard_words(docs, **sizes).collect()}
    assert sum(w for _, w in held.values()) == sum(words.values()) and all(n <= tree[s, k] for (s, k), (n, _) in held.items())
    mixed = mixing.mix(docs, **sizes)
    assert mixed.columns == ["doc_id", "text", "source", "nth", "mix_shard", "mix_order"]
    got = Counter((r.doc_id, r.mix_shard) for r in mixed.collect())
    assert sum(got.values()) == len(draws) and mixing.mix(mixed, **sizes).count() > 0
    assert len({s for _, s in got}) > 10


def test_mix_keeps_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (None, None, None), (7, "d e", None), (7, "f g h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter((r.doc_id, r.size) for r in mixing.taken(docs).collect()) == Counter([(None, 3), (None, 3), (None, 0), (7, 2), (7, 3)])
    assert sum(len(words_of(r.text)) for r in mixing.mix(docs).collect()) == sum(r.taken for r in mixing.taken(docs).collect())


def test_one_word_a_hundred_thousand_times(spark):
    docs = spark.createDataFrame([(1, "spam " * 100_000), (2, "spam eggs " * 50_000), (3, None), (1, "ham")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "spam " * 30), (8, "eggs spam")], "item_id long, text string")
    began = time.time()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(docs, bench).collect())
    assert got == [(1, 1, 0, 0), (1, 100_000, 100_000, 1), (2, 100_000, 99_998, 1), (3, 0, 0, 0)] and time.time() - began < 60


def test_a_text_of_three_megabytes(spark):
    rng = random.Random(2)
    long = " ".join(rng.choices([f"{a}{b}" for a in WORDS for b in "abcdefgh"], k=650_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[5000:5400]), (4, "")], "doc_id long, text string")
    assert len(long) > 3 << 19
    gone = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert gone[2] == (len(long), 1) and gone[3] == (400, 1) and gone[4] == (0, 0)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_join.groups(docs).collect()}
    assert found[2][1] == 1 and found[3][1] == 3 and found[4] == (0, 4)
    bench = spark.createDataFrame([(5, " ".join(long.split(" ")[300_000:300_020]))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contamination(docs, bench).where("n_hit = 20").collect()} == {1, 2}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, tokens.default_tokenizer(), tokens.CountCache(spark)).collect()}[4] == 0


def test_one_passage_in_every_document(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows = [(i, " ".join(rng.choices(WORDS, k=30)) + " ## " + passage + " ## " + str(rng.random()) * 5) for i in range(300)]
    seen, want = set(), {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(t[p : p + 100])
        want[i] = int(gone.sum())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_histograms_lose_no_link():
    rng = np.random.default_rng(6)
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(3, 900)).astype(np.uint64)
        sets = []
        for _ in range(8):
            keep = base[rng.random(len(base)) < rng.choice([0.85, 0.93, 0.97, 1.0])]
            more = rng.integers(0, 1 << 63, rng.integers(0, max(1, len(base) // 12))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([keep, more, base[:1]])))
        sets.sort(key=len)
        stay = similarity_join.promising(np.array(list(map(len, sets))), [similarity_join.histogram(s) for s in sets], 90)
        for i, j in itertools.combinations(range(8), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert stay[i] and stay[j]
    apart = [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(6)]
    assert not similarity_join.promising(np.array([400] * 6), [similarity_join.histogram(s) for s in apart], 90).any()


def test_keep_first_with_clashing_columns_null_ids_and_shared_ids(spark):
    text = " ".join(WORDS)
    rows = [(1, text, 0, "a"), (1, text + " more", 0, "b"), (1, "other words entirely stand here", 0, "c"), (None, "quite another text of words", 0, "d"), (None, "and one more of its own kind", 0, "e"), (None, None, 0, "f"), (2, text, 0, "g"), (1, text, 0, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id int, key string").withColumnRenamed("first_id", "_key")
    got = similarity_join.keep_first(docs)
    assert got.columns == docs.columns
    kept = Counter(r.key for r in got.collect())
    assert kept["c"] == kept["d"] == kept["e"] == kept["f"] == 1 and kept["a"] + kept["b"] == 1 and kept["g"] == 0
    assert similarity_join.keep_first(docs.limit(0)).count() == 0


def brute_quality_rows(docs, labels):
    """Discriminant scores by plain matrices: class densities with shrunk covariances, without the operator's moments or factors."""
    x = {i: quality.features([(t or "").encode()])[0] for i, t in docs}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = [(x[i], y) for i, y in labels if i in x and not held(i) and y in (0, 1)]
    of = [np.array([v for v, y in train if y == c]) for c in (0, 1)]
    cov = [np.cov(v.T, bias=True) for v in of]
    pooled = (len(of[0]) * cov[0] + len(of[1]) * cov[1]) / len(train)
    out = {}
    for i, v in x.items():
        dens = []
        for c in (0, 1):
            s = (1 - quality.SHRINK) * cov[c] + quality.SHRINK * np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(len(v))
            d = v - of[c].mean(0)
            dens.append(-0.5 * d @ np.linalg.inv(s) @ d - 0.5 * np.linalg.slogdet(s)[1])
        out[i] = dens[1] - dens[0]
    return out


def test_quality_orders_texts_as_plain_matrices_do(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        good = i % 2
        docs.append((i, " ".join(rng.choice(WORDS).capitalize() + ("." if rng.random() < 0.2 else "") for _ in range(rng.randint(30, 90))) if good else " ".join("$#" + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 60)))))
        labels.append((i, good if rng.random() < 0.9 else 1 - good))
    docs += [(900, None), (901, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS x", "2 AS label")
    got = {r.doc_id: r for r in quality.quality_scores(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute_quality_rows(docs, labels)
    ids = sorted(got)
    assert ids == sorted(want)
    score, plain = np.array([got[i].score for i in ids]), np.array([want[i] for i in ids])
    by = np.argsort(plain)
    assert (np.diff(score[by]) >= -1e-9).all()  # the score is a growing function of the density difference
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.7) for i in ids)


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    sentence = lambda k: " ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + "."
    good = [" ".join(sentence(rng.randint(5, 12)) for _ in range(12)) for _ in range(60)]
    leak = sentence(12)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(good)]
    rows += [(100 + i, good[i] + " tail", "s1") for i in range(8)] + [(200 + i, " ".join(sentence(9) for _ in range(12)) + " " + leak, "s0") for i in range(5)]
    rows += [(300 + i, " ".join("$#|" for _ in range(rng.randint(20, 60))), "s2") for i in range(60)]
    rows += [(None, good[30] + " null", None), (None, good[31] + " null", None), (40, sentence(90), "s1"), (400, None, "s0"), (401, "", "s0")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS x", "'k' AS key").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows if i is not None and i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (None, "never seen words of ten in a row are these here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stages_against_brute_force(spark, corpus_dir, tmp_path):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{corpus_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, corpus_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        seen.append((docs.collect(), (docs := spark.read.parquet(str(tmp_path / str(k)))).collect()))
    # quality: what the classifier itself predicts
    before, after = seen[0]
    labels = spark.read.parquet(f"{corpus_dir}/labels.parquet")
    good = Counter((r.doc_id, r.predicted) for r in quality.quality_scores(spark.read.parquet(f"{corpus_dir}/documents.parquet"), labels).collect())
    assert len(after) == sum(n for (_, p), n in good.items() if p) and not any((r.doc_id or 0) in range(300, 360) for r in after) and len(after) > 60
    # near duplicates: components by all pairs
    before, after = seen[1]
    sets = []
    for r in before:
        w = words_of(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at = list(range(len(before)))
    for i, j in itertools.combinations(range(len(before)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            at = [at[i] if x == at[j] else x for x in at]
    kept = Counter(at[next(i for i, b in enumerate(before) if (b.doc_id, b.text) == (r.doc_id, r.text))] for r in after)
    assert set(kept) == set(at) and max(kept.values()) == 1 and len(after) < len(before)
    # benchmark: windows of ten words
    before, after = seen[2]
    leak = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", next(r.text for r in spark.read.parquet(f"{corpus_dir}/benchmark.parquet").collect() if r.item_id == 1).lower())
    windows = {tuple(leak[i : i + 10]) for i in range(len(leak) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())] for i in range(len(w)))
    assert Counter(r.text for r in after) == Counter(r.text for r in before if not hit(r.text)) and len(after) < len(before)
    # the mix takes each source's words near its target, and cuts only texts' ends
    before, after = seen[3]
    size, took = Counter(), Counter()
    for r in before:
        size[r.source] += len(words_of(r.text))
    for r in after:
        took[r.source] += len(words_of(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, want in zip(names, mixing.targets([size[n] for n in names])):
        assert abs(took[s] - want) <= 1
    assert all(any(b.text and b.text.startswith(r.text) and b.doc_id == r.doc_id for b in before) for r in after)
    # token ids: what the library gives, in order of ids
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    before, after = seen[4]
    want = Counter((r.doc_id, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in before)
    assert Counter((r.doc_id, r.ids_crc32) for r in after) == want
    place = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens


def test_pipeline_of_an_empty_table(spark, corpus_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["é" * 50, None, "x" * 500, "", "y" * 60]})
    got = [texts for _, texts in slices(batch, limit=100)]
    assert [len(t) for t in got] == [2, 1, 2] and b"".join(itertools.chain(*got)) == ("é" * 50 + "x" * 500 + "y" * 60).encode()


def test_rows_without_ids_are_told_apart(spark):
    rng = random.Random(11)
    shared = " ".join(rng.choices(WORDS, k=60))
    texts = [f"{i} " + " ".join(f"{rng.randrange(10**9)}" for _ in range(20)) for i in range(1500)]
    texts += [f"{i} {shared} {i}" for i in range(40)] + [texts[0]] * 3
    for doc_id in (None, 7):
        rows = spark.createDataFrame([(doc_id, t) for t in texts] + [(9, "x" + texts[5])], "doc_id long, text string").repartition(4)
        got = defaultdict(list)
        for r in suffix_dedup.remove_repeats(rows, with_text=True).collect():
            got[r.doc_id].append((r.n_removed, bytes(r.kept).decode()))
        mine = got[doc_id]
        assert len(mine) == len(texts) and got[9] == [(len(texts[5]), "x")]
        cut = [x for x in mine if x[0]]
        assert len(cut) == 39 and sum(shared in t for _, t in mine) == 1  # one of the forty keeps the passage
        assert Counter(t for n, t in mine if not n and shared not in t) == Counter(texts[:1500] + texts[-3:])


def test_a_kept_cache_moves_no_text_again(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, None), (4, "other words here")], "doc_id long, text string")
    cache = tokens.CountCache(spark, str(tmp_path / "cache"))
    path = tokens.default_tokenizer()
    run = lambda df: sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, path, cache).collect())
    want = run(docs)
    assert [x[:2] for x in want] == [(1, 10), (2, 10), (3, 0), (4, 16)] and want[2][2] == 0
    moved = []
    monkeypatch.setattr(tokens, "packed", lambda rows, real=tokens.packed: moved.append(rows.count()) or real(rows))
    again = tokens.CountCache(spark, str(tmp_path / "cache"))
    assert run(docs) == want and not moved  # everything is known
    more = docs.unionByName(spark.createDataFrame([(5, "new"), (6, "new")], docs.schema))
    assert len(run(more)) == 6 and moved == [2]  # only the rows of the one new text
    assert again.read(tokens.tokenizer_digest(path)).count() == 4


def test_blocks_grow_with_the_corpus():
    assert mixing.grown(4096, 10**6) == 4096 and mixing.grown(4096, 2 * 10**12) == 4096
    for words in (5 * 10**12, 10**15):
        size = mixing.grown(4096, words)
        assert words / size <= mixing.MOST_BLOCKS < 10**9
    quota = np.array([400_000_000, 99_000_000, 1_000_000])  # what a draw may meet then
    left = mixing.left_half(quota, 0, 8, 0)
    assert left.sum() == quota.sum() // 2 and (left <= quota).all()


def test_shards_stand_in_the_order_of_their_shuffle(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40))), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    sizes = {"block_words": 64, "blocks_per_shard": 4}
    order = {}
    for r in mixing.mix(docs, **sizes).collect():
        order.setdefault((r.doc_id, r.text), []).append((r.mix_shard, r.mix_order))
    got = mixing.mixed_shards(docs, **sizes)
    assert got.columns == docs.columns
    parts = [[order[r.doc_id, r.text] for r in part] for part in got.rdd.glom().collect()]
    assert sum(map(len, parts)) == sum(map(len, order.values()))
    seen = [[places[0] for places in part if len(places) == 1] for part in parts]  # rows that were drawn once
    assert all(x == sorted(x) for x in seen) and [x for part in seen for x in part] == sorted(x for part in seen for x in part) and sum(map(len, seen)) > 100


def test_long_texts_in_the_other_operators(spark):
    """A text of some 2.5 MB is scored, counted, fingerprinted, mixed and written whole."""
    from layerloom.llm import fingerprints, id_files, language_model

    rng = random.Random(6)
    long = " ".join(rng.choices([f"{a}{b}" for a in WORDS for b in "abcdefgh"], k=500_000))
    assert len(long) > 2_000_000
    rows = [(1, long, "s", "en"), (2, "short text", "s", "en"), (None, "no id", "s", "en"), (None, None, None, None), (2, "short text", "s", "en"), (2, "another", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    path = tokens.default_tokenizer()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path, tokens.CountCache(spark)).collect()}[1] == len(ids)
    written = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in id_files.encode_documents(docs, path).collect()}
    assert (1, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) in written
    assert Counter((r.doc_id, r.size) for r in mixing.taken(docs).collect()) == Counter([(1, 500_000), (2, 2), (2, 2), (2, 1), (None, 2), (None, 0)])
    scores = Counter((r.doc_id, r.n_tokens) for r in language_model.text_scores(docs, depth=2).collect())
    assert scores == Counter([(1, 500_001), (2, 3), (2, 3), (2, 2), (None, 3), (None, 1)])
    prints = [(r.doc_id, r.n_chars) for r in fingerprints.compare_edited(docs).collect()]
    assert Counter(prints) == Counter((i, len(t or "")) for i, t, *_ in rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == len(rows)


def test_winnowing_window_by_window(spark):
    """Every window's least gram, the rightmost of equal ones, by a plain loop; and the likeness to the next document."""
    from layerloom.llm import fingerprints
    from layerloom.llm.common import byte_hash, span_hash

    rng = random.Random(12)
    k, w = fingerprints.GRAM, fingerprints.WINDOW
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, k + w - 2, k + w - 1, 60, 300)] + ["a" * 100, "abcabcabc" * 30, "naïve 日本 " * 9]

    def plain(text):
        data = np.frombuffer(text, np.uint8)
        prefix = byte_hash(data)
        h = [int(span_hash(prefix, np.array([i]), np.array([min(i + k, len(data))]))[0]) for i in range(max(len(data) - k + 1, min(1, len(data))))]
        kept = set()
        for a in range(max(len(h) - w + 1, min(1, len(h)))):
            some = range(a, min(a + w, len(h)))
            kept.add(min(some, key=lambda i: (h[i] >> 32, -i)))
        return [(i, h[i] & 0xFFFFFFFF) for i in sorted(kept)]

    raw = [t.encode() for t in texts]
    together = fingerprints.fingerprints(raw)
    for t, got in zip(raw, together):
        assert [tuple(x) for x in got.tolist()] == plain(t)
        assert fingerprints.decoded(fingerprints.encoded(got)).tolist() == got.tolist()
    rows = spark.createDataFrame([(None, "no id here at all, but some text"), *((i * 2, t) for i, t in enumerate(texts)), (4, "same id, other text")], "doc_id long, text string").repartition(3)
    got = fingerprints.compare_edited(rows).collect()
    assert len(got) == len(texts) + 2
    sets = {i: {g for _, g in plain(t.encode())} for i, t in enumerate(texts)}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    by = {r.doc_id: r for r in got if r.doc_id != 4}
    for i in range(len(texts) - 1):
        if 2 * i not in (2, 4):  # neighbours of the repeated id
            assert by[2 * i].near_next == pytest.approx(alike(sets[i], sets[i + 1]))
    assert by[2 * len(texts) - 2].near_next == pytest.approx(alike(sets[len(texts) - 1], {g for _, g in plain(b"no id here at all, but some text")}))
