"""The quality classifier and the toxicity network: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollmill.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    good, bad = np.array(score)[np.array(y) == 1], np.array(score)[np.array(y) == 0]
    return (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2


def truth(spark, label):
    return {r["doc_id"]: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_quality_on_rows_it_did_not_see(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0)
    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, quality.fit(docs, known), ["doc_id"]).collect()}
    held = {i: y for i, y in truth(spark, "quality").items() if zlib.crc32(str(i).encode()) % 3 == 0}
    assert len(score) == docs.count() and auc([score[i] for i in held], list(held.values())) > 0.95
    assert sum(score[i] < 0.5 for i, y in held.items() if y == 1) <= 3


def test_views_exchange_labels():
    draw = np.random.default_rng(1)
    y = (np.arange(400) % 2).astype(float)
    side = lambda y, n: y[:, None] * 2 - 1 + draw.normal(0, 0.4, (len(y), n))
    u = (np.arange(300) % 2).astype(float)
    model = quality.co_train(side(y, 3), side(y, 2), y, side(u, 3), side(u, 2))
    a, b, both = model.score(side(u, 3), side(u, 2))
    assert min(auc(a, u), auc(b, u)) > 0.95 and auc(both, u) > 0.99
    assert quality.co_train(side(y, 3), side(y, 2), np.ones(400), side(u, 3), side(u, 2)) is None


def test_network_gradients():
    draw = np.random.default_rng(0)
    lexicon = toxicity.Lexicon([b"one", b"two", b"three"])
    network = toxicity.Network(np.array([0.5, -0.5, 0.1]))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    windows = [[b"one", b"five", b"two"], [b"three"], []]
    distinct, codes, lengths = toxicity._coded(windows)
    lex = lexicon.words(distinct)
    pull = draw.normal(size=3)
    loss = lambda: float(network.forward(network.inputs(lex).astype(np.float64), codes, lengths) @ pull)
    keep = {}
    x = network.inputs(lex)
    network.forward(x, codes, lengths, keep)
    grads = network.backward(x, codes, keep, pull.astype(np.float32), lex)
    for name in ("Wf", "Ub", "att", "out", "char", "word", "cf"):
        flat, g = network.p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            if name == "word" and i < toxicity.WORD_DIM:
                continue
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 0.02 * max(1, abs(g[i]))


def test_every_window_counts(spark, documents):
    texts = [" ".join(["calm"] * (i % 90 + 3)) for i in range(300)]
    for i in range(0, 300, 3):
        w = texts[i].split()
        w[(i * 7) % len(w)] = "awful"
        texts[i] = " ".join(w)
    docs = documents(texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], LABELS)
    scorer = toxicity.fit(docs, labels, usable=F.col("i") % 5 != 0)
    long = [" ".join(["calm"] * n + ["awful"] + ["calm"] * (400 - n)) for n in (0, 47, 48, 200, 399, 400)] + [" ".join(["calm"] * 500)]
    score = [r["score"] for r in toxicity.score(documents(long), scorer, ["doc_id"]).orderBy("doc_id").collect()]
    assert min(score[:6]) > 0.5 > score[6]


@pytest.mark.parametrize("n", [0, 1, 48, 49, 80, 81, 500])
def test_windows_cover_the_text(n):
    starts = toxicity._starts(n)
    covered = {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))}
    assert covered == set(range(n)) and len(set(starts)) == len(starts)


def test_edge_cases(spark, clashing):
    none = spark.createDataFrame([], LABELS)
    assert quality.fit(clashing, none) is None and toxicity.fit(clashing, none, usable=F.lit(True)) is None
    kept = quality.classify(clashing, None, ["doc_id"])
    assert {(r["score"], r["predicted"]) for r in kept.collect()} == {(0.5, 1)} and kept.count() == clashing.count()
    scored = toxicity.score(clashing, None, ["doc_id"])
    assert {r["score"] for r in scored.collect()} == {0.5} and scored.count() == clashing.count()
    odd = spark.createDataFrame([(0, None, None), (0, 1, 1), (0, 0, 0), (None, 1, 1), (6, 0, 0)], LABELS)
    quality.fit(clashing, odd)
    toxicity.fit(clashing, odd, usable=F.lit(True))
    empty = clashing.limit(0)
    assert quality.classify(empty, quality.fit(empty, odd), ["doc_id"]).count() == 0 and toxicity.score(empty, None, ["doc_id"]).count() == 0
