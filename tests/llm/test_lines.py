"""Deleted lines against brute force over all pairs of places."""

import random

import pytest

from tollmill.llm import lines


def brute(docs, least):
    seq = []
    for i in sorted(docs):
        seq += [(i, n, t.strip(), len(t.split())) for n, t in enumerate(docs[i].split("\n")) if t.strip()]
        seq.append((None, None, object(), 0))
    out = set()
    for i in range(len(seq)):
        for j in range(i if seq[i][0] is not None else 0):
            k = words = 0
            while seq[i + k][2] == seq[j + k][2]:
                words += seq[i + k][3]
                k += 1
            if words >= least:
                out.update((seq[i + t][0], seq[i + t][1]) for t in range(k))
    return out


def deleted(df, docs, least):
    rows = lines.dedup(df, min_words=least).collect()
    gone = {(r["doc_id"], n) for r in rows for run in r["_runs"] or () for n in range(run["lo"], run["hi"] + 1)}
    for r in rows:
        kept = [t for n, t in enumerate(docs[r["doc_id"]].split("\n")) if (r["doc_id"], n) not in gone]
        assert r["text"] == "\n".join(kept)
    return {(i, n) for i, n in gone if docs[i].split("\n")[n].strip()}


@pytest.mark.parametrize("seed, least", [(1, 10), (2, 1), (3, 17)])
def test_random_lines(documents, seed, least):
    draw = random.Random(seed)
    pool = [" ".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 6))) for _ in range(9)]
    docs = {}
    for i in range(40):
        text = [draw.choice(pool) if draw.random() < 0.8 else f"{draw.random()} x y" for _ in range(draw.randint(0, 18))]
        if i > 5 and draw.random() < 0.4:
            text[1:1] = docs[draw.randrange(i)].split("\n")[2:8]
        if draw.random() < 0.2:
            text[2:2] = ["", "  "]
        docs[i] = "\n".join(text)
    assert deleted(documents(list(docs.values())), docs, least) == brute(docs, least)


def test_nulls_repeats_and_extra_columns(clashing):
    rows = lines.dedup(clashing, min_words=3).collect()
    assert len(rows) == clashing.count()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert lines.dedup(clashing.limit(0)).count() == 0


def test_line_said_many_times(documents):
    docs = {0: "\n".join(["again and again"] * 400)}
    assert deleted(documents([docs[0]]), docs, 50) == brute(docs, 50)


def test_runs_name_the_source_of_each_line(documents):
    first, second = [f"first text line {i}" for i in range(6)], [f"second text line {i}" for i in range(6)]
    docs = ["\n".join(first), "\n".join(["own words"] + second), "\n".join(["begin here"] + first[1:] + second[:5] + ["end here"])]
    rows = {r["doc_id"]: r for r in lines.dedup(documents(docs), min_words=12).collect()}
    assert [tuple(r) for r in rows[2]["_runs"]] == [(1, 5, 0, 1), (6, 10, 1, 1)]
    assert rows[2]["text"] == "begin here\nend here" and rows[0]["_runs"] is None


def test_columns_named_like_those_inside(documents):
    from pyspark.sql import functions as F

    text = "\n".join(f"line number {i} of many" for i in range(30))
    names = ["_runs", "_h", "_i", "_th", "h", "of", "hash", "runs", "lines", "doc", "a.b"]
    docs = documents([text, text + "\nmore"]).withColumns({c: F.lit(c) for c in names})
    rows = lines.dedup(docs, runs_col="cut").orderBy("doc_id").collect()
    assert all(r[c] == c for r in rows for c in names) and rows[1]["text"] == "more" and rows[1]["cut"][0]["of_id"] == 0
    assert lines.dedup(docs).filter(F.col("_runs").isNotNull()).count() == 1


def test_very_long_text(documents):
    """20 000 lines, half of them repeated: cost follows the number of lines."""
    block = [f"some line {i} with five words" for i in range(10_000)]
    rows = lines.dedup(documents(["\n".join(block + ["x"] + block)])).collect()
    assert rows[0]["text"] == "\n".join(block + ["x"]) and [tuple(r) for r in rows[0]["_runs"]] == [(10_001, 20_000, 0, 0)]
