"""The pool of pseudo-labels is all unlabelled rows, and what comes to the driver of it are the surest."""

import numpy as np
from pyspark.sql import functions as F

from tollmill.llm import quality

DATA = "/root/testdata/sf0.01"


def pool_of(spark, scores):
    rows = [(i, [float(s)] + [float(i)] * 15, [i % 8, 8 + i % 64, 72 + i % 12]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "h long, t array<float>, m array<int>").repartition(5)


def test_surest_rows_of_the_whole_pool(spark):
    class Graded:
        """A view that takes the first number of a text's features as its score."""

        def score(self, x):
            return x[:, 0]

    scores = np.concatenate([np.linspace(0.971, 0.999, 3000), np.linspace(0.001, 0.029, 3000), np.full(100, 0.5)])
    x, y = quality._surest(pool_of(spark, scores), "text", Graded(), 1.0, 0.97, 10_000)
    assert len(y) == 6000 and y.sum() == 3000 and x.shape == (6000, 84)
    _, y = quality._surest(pool_of(spark, scores), "text", Graded(), 2.0, 0.97, 300)
    assert abs(y.sum() - 100) <= 10 and abs(len(y) - 300) <= 20
    tied = np.concatenate([np.full(2000, 0.99), np.full(2000, 0.01)])
    _, y = quality._surest(pool_of(spark, tied), "text", Graded(), 1.0, 0.97, 400)
    assert abs(y.sum() - 200) < 60 and abs(len(y) - 400) < 90
    assert len(quality._surest(pool_of(spark, np.full(5, 0.5)), "text", Graded(), 1.0, 0.97, 400)[1]) == 0


def test_every_unlabelled_row_is_in_the_pool(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    monkeypatch.setattr(quality, "_surest", lambda pool, *_: (seen.append(pool.count()), (np.zeros((0, 84 if len(seen) % 2 else 16)), np.zeros(0)))[1])
    assert quality.fit(docs, labels, sample=50) is not None
    unlabelled = docs.join(labels.filter(F.col("quality").isNotNull()), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).count()
    assert set(seen) == {unlabelled} and unlabelled > 50
