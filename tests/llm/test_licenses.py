"""Notices are found exactly where their shingles are."""

import random

import pytest

from tollmill.llm import licenses as l

SCHEMA = "template string, text string"


def test_notices_at_every_offset(spark, documents):
    draw = random.Random(1)
    word = lambda: draw.choice("bcdfg") + draw.choice("aeiou") + str(draw.randrange(99))
    texts, want = [], set()
    for i in range(60):
        name, notice = l.TEMPLATES[i % len(l.TEMPLATES)]
        before, after = [word() for _ in range(i)], [word() for _ in range(draw.randrange(30))]
        texts.append(" ".join(before) + "\n" + notice.upper() + "&& " + " ".join(after))
        want.add((i, name, i))
    names = spark.createDataFrame([(n, t) for n, t in l.TEMPLATES], SCHEMA)
    found = {(r["doc_id"], r["template"], r["first_word"]) for r in l.scan(documents(texts + [" ".join(word() for _ in range(500))]), names).collect() if r["containment"] == 1}
    # at most one in 2^8 of the shortest notices may be missed by the bands
    assert found <= want and len(want - found) <= 1


def test_edited_and_near_templates(spark, documents):
    names = spark.createDataFrame([("gpl3", "This work is licensed under the GNU General Public License, version 3."), ("gpl2", "This work is licensed under the GNU General Public License, version 2.")], SCHEMA)
    text = "x y. This work is licensed under the GNU General Public License, version 3. z"
    assert [r["template"] for r in l.scan(documents([text, "This work is licensed to you"]), names).collect()] == ["gpl3"]


def test_short_templates_are_refused(spark, documents):
    with pytest.raises(ValueError):
        l.scan(documents(["x"]), spark.createDataFrame([("a", "too short")], SCHEMA))


def test_nulls_repeats_and_extra_columns(spark, clashing):
    names = spark.createDataFrame([("n", "one two three four five six"), ("none", None)], SCHEMA)
    assert [tuple(r) for r in l.scan(clashing, names).collect()] == [(0, "n", 1.0, 0)]
    assert l.scan(clashing.limit(0), names).count() == 0
