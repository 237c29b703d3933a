"""Estimates against true similarities; edited texts; neighbours."""

import random

from pyspark.sql import functions as F

from tollmill.llm import fingerprints as f


def jaccard(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b)


def test_estimates(documents):
    draw = random.Random(2)
    words = [" ".join(draw.choice("abcdefgh") * 2 + str(draw.randrange(50)) for _ in range(n)) for n in (1, 4, 5, 30, 400, 401, 2000)]
    texts = [*words, words[4], words[4] + " more of it", "\n".join(words[:4]), None, ""]
    rows = {r["id"]: r for r in f.with_next(documents(texts)).withColumn("like", f.likeness(F.col("fp"), F.col("next_fp"))).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        assert rows[i]["next_part"] == after[: len(text) // 4]
        assert abs(rows[i]["like"] - jaccard(text, after)) < 0.15
    assert rows[4]["fp"] == rows[7]["fp"] and rows[10]["fp"] == rows[11]["fp"] and rows[10]["like"] == 1.0


def test_repeats_nulls_and_extra_columns(clashing):
    got = f.with_next(clashing).select("id", "text", "fp").collect()
    assert len(got) == clashing.count()
    assert len({tuple(r["fp"]) for r in got if r["text"].startswith("one")}) == 1
    assert f.with_next(clashing.limit(0)).count() == 0


def test_the_only_document_is_its_own_next(documents):
    row = f.with_next(documents(["some words of a text here"])).first()
    assert row["next_part"] == "some w" and row["fp"] == row["next_fp"]
