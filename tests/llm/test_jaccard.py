"""Components against brute force, with groups cut into blocks and with every list long."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from tollmill.llm import jaccard


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def corpus(seed):
    draw = random.Random(seed)
    base = [[draw.choice("abcdefghijklmnopqrstuvwxyz") * 2 + str(draw.randrange(40)) for _ in range(draw.choice([30, 60, 61, 200]))] for _ in range(9)]
    texts = []
    for _ in range(300):
        words = list(draw.choice(base)) if draw.random() < 0.8 else [str(draw.random()) for _ in range(40)]
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            words[draw.randrange(len(words))] = str(draw.randrange(9999))
        if draw.random() < 0.4:
            words[5:5] = base[0][:20]
        texts.append(" ".join(words))
    return [*texts, None, "", "a b", "A  b", "c", "  ", "c"]


@pytest.mark.parametrize("block, long", [(4_000_000, 64), (2000, 4)])
def test_components(documents, monkeypatch, block, long):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LONG", long)
    texts = corpus(block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(documents(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_divide_skip_connects_what_links(monkeypatch):
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        s = np.arange(100, dtype=np.uint64) + np.uint64(1000 * (len(sets) % 3))
        s[draw.integers(0, 100, 6)] = draw.integers(10_000, 99_999, 6)
        sets.append(np.unique(s))
    linked = defaultdict(set)
    for a, b in jaccard.divide_skip(sets, 85):
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        linked[a].add(b)
    root = jaccard.roots_of(60, np.array([(a, b) for a in linked for b in linked[a]]))
    true = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert (root == jaccard.roots_of(60, np.array(true))).all()


def test_nulls_repeats_and_extra_columns(clashing):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(clashing).collect()), key=repr)
    assert got == sorted([(0, 4, 0), (0, 4, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, 6), (6, 1, 6)], key=repr)
    assert jaccard.join_components(clashing.limit(0)).count() == 0


def test_search_costs_as_much_as_its_lists():
    """Many sets with one common n-gram: no pass over all of them for each search."""
    draw = np.random.default_rng(1)
    sets = [np.unique(np.append(draw.integers(2, 1 << 60, 8), 1)).astype(np.uint64) for _ in range(20_000)]
    began = time.monotonic()
    assert jaccard.divide_skip(sets, 85) == [] and time.monotonic() - began < 20


def test_sets_too_small_to_link_are_no_candidates(documents):
    """Sets of five n-grams and fewer link at 85 % with equal ones only; a set of six links with one of seven."""
    small = [f"a b c d {i} {i} x{i} y{i}" for i in range(300)]
    texts = [*small, small[0], "p q r s t u v w x", "p q r s t u v w x y"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(documents(texts)).collect()}
    assert got == brute(dict(enumerate(texts))) and got[300][1] == 0 and got[302][1] == 301
    bits = documents(texts).sparkSession.sparkContext.broadcast(np.zeros(8192, np.uint8))
    assert jaccard.candidates(documents(small), 4, 85, bits, 8).count() == 0


def test_sets_are_searched_only_where_rare_grams_meet(documents, monkeypatch):
    """Each text shares a phrase with one other, but its rarest n-grams are its own: none is sent in full."""
    texts = [" ".join([f"p{i // 2}x{k}" for k in range(8)] + [f"w{i}y{k}" for k in range(60)]) for i in range(200)]
    searched, tasks = [], jaccard._tasks
    monkeypatch.setattr(jaccard, "_tasks", lambda rows, parts, *a: (searched.append(parts.count()), tasks(rows, parts, *a))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(documents(texts)).collect()}
    assert got == brute(dict(enumerate(texts))) and searched == [0]


def test_levels_follow_counts(documents):
    texts = [f"once {i} {i + 1} {i + 2}" for i in range(20)] + ["both a b c"] * 2 + ["four a b c"] * 4 + ["many a b c"] * 17
    texts = documents([f"{t} own{i}" for i, t in enumerate(texts)]).select("text")
    maps = jaccard.level_maps(texts, 4, 100, 8)
    told = {
        t: jaccard.levels_of(jaccard.gram_sets([f"{t}".encode()], 4)[0], maps).tolist()
        for t in ("once 3 4 5", "both a b c", "four a b c", "many a b c", "a b c own20", "not in any text")
    }
    assert list(told.values()) == [[0], [1], [2], [3], [0], [0]]


def test_keys_grow_with_the_number_of_grams():
    """Chance alone must not make n-grams of large corpora look frequent: 64 keys for each."""
    assert all(jaccard._key_bits(g) >= np.log2(g) + 6 for g in (10**6, 10**8, 15 * 10**8, 10**11))


@pytest.mark.parametrize("percent", [80, 85])
def test_full_maps_change_no_result(documents, monkeypatch, percent):
    texts = corpus(7)
    plain = sorted(jaccard.join_components(documents(texts), percent=percent).collect())
    monkeypatch.setattr(jaccard, "level_maps", lambda *a: [np.full(8192, 255, np.uint8)] * 5)
    assert sorted(jaccard.join_components(documents(texts), percent=percent).collect()) == plain


def test_query_returns_its_columns(spark):
    from tests.conftest import DATA

    got = jaccard.op10_jaccard(spark, DATA)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"] and got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
