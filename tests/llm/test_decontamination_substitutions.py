"""No passage that meets the bars is missed for want of a seed: all patterns of substitutions, and whole runs against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from tollmill.llm import decontamination as d

ITEMS = "item_id long, text string"


def bar(n):
    return min(d.MIN_WORDS, max(d.SHORTEST, -(-3 * n // 4)))


@pytest.mark.parametrize("n", range(5, 18))
def test_a_seed_in_every_pattern(n):
    masks = [(len(m), int(m, 2)) for m in d.MASKS]
    for holes in combinations(range(n), n - bar(n)):
        kept = (1 << n) - 1 - sum(1 << h for h in holes)
        assert any((kept >> at) & m == m for size, m in masks for at in range(n - size + 1))


def test_no_longer_stretch_without_a_seed():
    # fewest disagreeing places of a stretch without any seed, by its last places and the number of agreeing ones
    masks = [int(m, 2) for m in d.MASKS]
    span = max(map(len, d.MASKS))
    fewest = {0: 0}
    for agreeing in range(1, 80):
        following: dict[int, int] = {}
        for state, zeros in fewest.items():
            for more in range(span + 1):
                last = ((state << more) << 1 | 1) & ((1 << span) - 1)
                if not any(last & m == m for m in masks):
                    following[last] = min(following.get(last, 10**6), zeros + (more if agreeing > 1 else 0))
        fewest = following
        assert agreeing < d.MIN_WORDS or not fewest or 3 * min(fewest.values()) > agreeing


def test_most_agreeing_words_of_a_stretch():
    draw = np.random.default_rng(4)
    for _ in range(300):
        same = draw.random(draw.integers(1, 40)) < draw.choice([0.5, 0.75, 0.9])
        item = np.arange(len(same))
        doc = np.where(same, item, -1)
        fits = [
            (int(same[a:b].sum()), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 4 * same[a:b].sum() >= 3 * (b - a)
        ]
        most, size = max(fits, default=(0, 0))
        assert d.agreement(doc, item, [0], 0.75)[:2] == ((most, -size) if most >= d.SHORTEST else (0, 0))


def test_substitutions_like_brute_force(spark, documents):
    draw = random.Random(12)
    words = lambda n: [f"{draw.choice('abcdefghij')}{draw.randrange(10**6)}" for _ in range(n)]
    items = [words(n) for n in range(5, 31) for _ in range(4)]
    texts = []
    for item in items:
        changed = list(item)
        for at in draw.sample(range(len(item)), draw.randrange(len(item) // 4 + 2)):
            changed[at] = "other"
        texts.append(words(draw.randrange(30)) + changed + words(draw.randrange(30)))
    want = set()
    for i, item in enumerate(items):
        for s in range(-len(item), len(texts[i])):
            same = [0 <= k + s < len(texts[i]) and w == texts[i][k + s] for k, w in enumerate(item)]
            if any(
                sum(same[a:b]) >= bar(len(item)) and 4 * sum(same[a:b]) >= 3 * (b - a) for a in range(len(item)) for b in range(a + 1, len(item) + 1)
            ):
                want.add((i, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(documents([" ".join(t) for t in texts]), bench).collect()}
    assert got == want and 40 < len(want) < len(items)
