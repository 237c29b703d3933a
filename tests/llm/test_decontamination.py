"""Planted passages, with substitutions and put-in words, are found; clean texts are not."""

import random

import pytest

from tollmill.llm import decontamination as d

ITEMS = "item_id long, text string, item string, at string"


def item(draw, n):
    return " ".join(draw.choice("abcdefghijklmnop") * 3 + str(draw.randrange(30)) for _ in range(n))


def test_planted_passages(spark, documents):
    draw = random.Random(8)
    items = [item(draw, n) for n in (60, 40, 30, 14, 9, 5, 4)]
    noise = lambda: item(draw, 50) + " other"
    changed = items[0].split()
    for i in range(6, 60, 9):
        changed[i] = "replaced"
    longer = items[1].split()
    longer.insert(20, "extra")
    texts = [noise() + "\n" + t.upper() + "! " + noise() for t in (items[0], " ".join(changed), " ".join(longer), items[2], items[3], items[4], items[5])]
    clean = [noise(), items[0][: len(items[0]) // 8], items[6], None, "", " ".join(sorted(items[0].split()))]
    bench = spark.createDataFrame([*((i, t, "x", "y") for i, t in enumerate(items)), (90, items[0], "x", "y"), (91, None, "x", "y"), (92, "", "x", "y")], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(documents(texts + clean), bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)}


@pytest.mark.parametrize("seeds, words", [(1_000_000, 2_000_000), (0, 0)])
def test_broadcast_or_shuffle_gives_the_same(spark, documents, monkeypatch, seeds, words):
    monkeypatch.setattr(d, "MOST_SEEDS", seeds)
    monkeypatch.setattr(d, "MOST_WORDS", words)
    draw = random.Random(9)
    items = [item(draw, 30) for _ in range(5)]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(items)], ITEMS)
    got = sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in d.leaks(documents([f"some text {t} more" for t in items] * 3), bench).collect())
    assert got == sorted((i, i % 5, 30) for i in range(15))


def test_nulls_repeats_and_extra_columns(spark, clashing):
    bench = spark.createDataFrame([(3, "one two three four five six seven", "x", "y")], ITEMS)
    assert [tuple(r)[:4] for r in d.leaks(clashing, bench).collect()] == [(0, 3, 7, 7)]
    assert d.leaks(clashing.limit(0), bench).count() == 0 and d.leaks(clashing, bench.limit(0)).count() == 0
