"""Many near copies of one text in the n-gram Jaccard join: who meets whom, and links by counted overlaps."""

import itertools
import random

import numpy as np
import pytest

from layerloom.llm import similarity_join


def components(n, pairs, apart=()):
    label = list(range(n))
    for i, j in pairs:
        label = [label[i] if x == label[j] else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


def near_copies(rng, n, words, changes):
    """``changes(rng)`` words of one text replaced by words of each copy's own; some copies are cut or go on."""
    base = [f"w{i}" for i in range(words)]
    for i in range(n):
        text = list(base)
        for k, at in enumerate(rng.sample(range(words), changes(rng))):
            text[at] = f"own{i}x{k}"
        cut = rng.choice([0, 0, 0, words // 30, words // 8, -5, -words // 9])
        yield i, " ".join(text[: len(text) - cut] if cut >= 0 else [*text, *(f"more{i}x{k}" for k in range(-cut))])


def exact(sets, percent):
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            yield i, j


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_large_groups_are_counted(percent, monkeypatch):
    """A group of many near copies walks no tree, which took time with the square of its size."""
    monkeypatch.setattr(similarity_join, "PrefixTree", None)
    rng = np.random.default_rng(percent)
    base = np.unique(rng.integers(0, 1 << 63, 120).astype(np.uint64))
    pool = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.97])], rng.choice(pool, rng.integers(0, 20)), rng.integers(0, 1 << 63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(150)]
    sets += [np.array([5], np.uint64), np.array([5], np.uint64), np.array([7], np.uint64), base]
    links = list(exact([set(s.tolist()) for s in sets], percent))
    assert links and set(similarity_join.connect(sets, percent)) <= {p for i, j in links for p in ((i, j), (j, i))}
    assert components(len(sets), similarity_join.connect(sets, percent)) == components(len(sets), links)
    walkers = list(range(0, len(sets), 3))
    mine = [(i, j) for i, j in links if i in walkers or j in walkers]
    assert components(len(sets), similarity_join.connect(sets, percent, walkers=walkers)) == components(len(sets), mine)
    assert similarity_join.connect([np.array([i], np.uint64) for i in range(70)], percent) == []


@pytest.mark.parametrize("words, percent, split", [(5, 80, 1500), (3, 90, 1500), (3, 90, 70), (2, 50, 90)])
def test_near_copies_and_brute_force(spark, words, percent, split):
    rows = list(near_copies(random.Random(words), 160, 90, lambda r: r.choice([0, 1, 1, 2, 3, 5, 9, 20])))
    sets = [{tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} for t in (text.split() for _, text in rows)]
    want = {min(c): c for c in components(len(rows), exact(sets, percent))}
    got = similarity_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), words, percent, split).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), first) for first, c in want.items() for d in c}


def test_copies_with_too_many_changes_meet_nobody(spark):
    """Sets of one size whose first 11 elements are their own share too few for 90 percent, though the prefix of 20 goes on with what all have."""
    rows = [(i, 200, [1000 * i + k for k in range(15 if i else 8)] + [-9 + k for k in range(6)]) for i in range(50)]
    classes = spark.createDataFrame(rows, "class_id long, n long, prefix array<long>")
    assert similarity_join.meeting(classes, 90).count() == 0
    smaller = spark.createDataFrame([(99, 192, [-9, -8])], "class_id long, n long, prefix array<long>")
    assert {(r.class_id, r.leader) for r in similarity_join.meeting(classes.unionByName(smaller), 90).collect()} == {(0, 99), (99, 99)}
