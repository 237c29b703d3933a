"""Operator 8: a quality classifier by co-training of two views.

One view is the text alone (shares of kinds of characters, repetition of words and lines, lengths), the other the metadata
alone (language, source, length). Each is a logistic regression. In each round both are fitted and calibrated, and each
labels the unlabelled rows of which it is sure; these go to the training set of the other. In the end both scores are
calibrated on labelled rows kept aside and combined by a small logistic regression; it scores every document.

The classifiers are fitted on a bounded sample: at most ``SAMPLE`` labelled rows, those with the smallest hash of their id.
The pool from which the views label rows for each other is all unlabelled rows: their features are stored, scored on the
executors in each round, and about ``SUREST`` rows of which the view is surest come to the driver. Everything else covers all
rows: each document is scored from its whole text inside its own task, so scoring shuffles nothing and every row gives one row.

Null texts count as empty and null metadata as a value of its own. Ids may repeat: each row is scored by its own content.
Labels of one id that differ are averaged (0.5 counts as 1); null labels count as missing. Without labels of both kinds,
nothing is known and every document scores 0.5 and is kept.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.llm.common import chunks, stored, table

SAMPLE = 20_000
#: How many rows that a view labels train the other view at most (of both kinds together, about).
SUREST = 20_000
ROUNDS = 4
#: How sure a view has to be of a row to label it for the other view.
SURE = 0.97
_SOURCES = 64
_STEPS = 1024

_KINDS = np.zeros((256, 8))
for _column, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r\t", b".,;:'\"()-?", b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _KINDS[list(_chars), _column] = 1
_KINDS[128:, 7] = 1


def text_view(text: str) -> list[float]:
    """What the first classifier sees of a text."""
    data = text.encode()
    words = data.split()
    if not words:
        return [1.0] + [0.0] * 15
    kinds = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _KINDS / len(data)
    lines = data.split(b"\n")
    n, distinct = len(words), set(words)
    again = sum(map(eq, words, words[1:]))
    ends = sum(1 for w in distinct if w[-1] in b"!#$%&*|") / len(distinct)
    return [
        0.0, *kinds.tolist(), np.log1p(n), len(data) / n, len(distinct) / n, np.log1p(len(distinct)) / np.log1p(n), again / n,
        1 - len(set(lines)) / len(lines), ends,
    ]


def meta_view(lang, source, n_chars) -> tuple[int, int, int]:
    """What the second classifier sees of the metadata: a class of languages, of sources and of lengths."""
    from zlib import crc32

    length = 11 if n_chars is None else min(10, int(np.log2(max(0, n_chars) + 1) * 0.6))
    return crc32(repr(lang).encode()) % 8, 8 + crc32(repr(source).encode()) % _SOURCES, 8 + _SOURCES + length


def one_hot(classes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(classes), 8 + _SOURCES + 12))
    out[np.arange(len(classes))[:, None], classes] = 1.0
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class View:
    """A classifier of one view: standardised features (and their squares, where asked for), then a calibrated score."""

    def __init__(self, squares: bool):
        self.squares = squares

    def _features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([z, z * z]) if self.squares else z

    def fit(self, x, y, x_cal, y_cal):
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.weights = fit_logistic(self._features(x), y)
        self.scale = fit_logistic(self.raw(x_cal)[:, None], y_cal, ridge=1e-2)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._features(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.raw(x) + self.scale[1])


class CoTrained:
    """Both views and their combination."""

    def __init__(self, text: View, meta: View, combine: np.ndarray):
        self.text, self.meta, self.combine = text, meta, combine

    def score(self, x_text, x_meta):
        a, b = self.text.score(x_text), self.meta.score(one_hot(x_meta) if x_meta.dtype.kind == "i" else x_meta)
        return a, b, _sigmoid(np.column_stack([_logit(a), _logit(b)]) @ self.combine[:-1] + self.combine[-1])


def _wanted(good: int, bad: int, odds: float, most: int) -> tuple[int, int]:
    """How many of the rows that a view is sure of it labels: in the proportion of the labelled rows, as far as it is sure of both kinds."""
    n_good = min(good, int(bad / odds), int(most / (1 + odds)))
    return n_good, min(bad, int(round(n_good * odds)))


def _exchange(xt, xm, y, choose, rounds: int) -> CoTrained | None:
    """Fits both views on labelled rows, and in each round on the rows that ``choose(name, view, odds)`` gives with the labels of the other view."""
    aside = np.random.default_rng(3).random(len(y)) < 0.25
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return None
    fit, cal = ~aside, aside
    odds = max((1 - y[fit].mean()) / max(y[fit].mean(), 1e-6), 1e-6)
    (et, ty), (em, my) = (xt[:0], y[:0]), (xm[:0], y[:0])
    for turn in range(rounds):
        text = View(True).fit(np.vstack([xt[fit], et]), np.concatenate([y[fit], ty]), xt[cal], y[cal])
        meta = View(False).fit(np.vstack([xm[fit], em]), np.concatenate([y[fit], my]), xm[cal], y[cal])
        if turn + 1 < rounds:
            (em, my), (et, ty) = choose("text", text, odds), choose("meta", meta, odds)
    both = np.column_stack([_logit(text.score(xt[cal])), _logit(meta.score(xm[cal]))])
    return CoTrained(text, meta, fit_logistic(both, y[cal], ridge=1.0))


def co_train(xt, xm, y, ut, um, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained | None:
    """Fits both views on labelled rows (xt, xm, y) and unlabelled rows (ut, um); about a quarter of the labelled rows are kept aside."""

    def choose(name: str, view: View, odds: float):
        own, other = (ut, um) if name == "text" else (um, ut)
        scores = view.score(own)
        good, bad = np.flatnonzero(scores >= sure), np.flatnonzero(scores <= 1 - sure)
        n_good, n_bad = _wanted(len(good), len(bad), odds, len(scores))
        good = good[np.argsort(-scores[good], kind="stable")[:n_good]]
        bad = bad[np.argsort(scores[bad], kind="stable")[:n_bad]]
        return other[np.concatenate([good, bad])], np.concatenate([np.ones(len(good)), np.zeros(len(bad))])

    return _exchange(xt, xm, y, choose, rounds)


def _views(docs: DataFrame, keep: list[str]):
    """(kept columns, text, lang, source, n_chars) under plain names; missing metadata columns are null."""
    has = set(docs.columns)
    return docs.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[(F.col(c).cast("string") if c in has else F.lit(None).cast("string")).alias(f"m_{c}") for c in ("lang", "source")],
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("m_n"),
    )


def _arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t) for t in part.column("text").to_pylist()])
    meta = np.array([meta_view(*m) for m in zip(*(part.column(c).to_pylist() for c in ("m_lang", "m_source", "m_n")))], dtype=np.int32)
    return text, meta


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return np.array(column.to_pylist())


def _surest(pool: DataFrame, name: str, view: View, odds: float, sure: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What the other view sees of the rows of the pool of which this view is surest, and the labels it gives them."""
    other, kind = ("m", "array<int>") if name == "text" else ("t", "array<float>")

    def score(batches):
        for part in batches:
            if part.num_rows == 0:
                continue
            s = view.score(_matrix(part.column("t")).astype(float) if name == "text" else one_hot(_matrix(part.column("m"))))
            label = (s >= 0.5).astype(np.int32)
            step = (np.maximum(s, 1 - s) - sure) / (1 - sure) * (_STEPS - 1)  # how sure, in equal steps
            kept = pa.array(np.flatnonzero(step >= 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(label).take(kept), pa.array(step.astype(np.int32)).take(kept), part.column("h").take(kept), part.column(other).take(kept)],
                ["label", "step", "h", "x"],
            )

    scored = pool.mapInArrow(score, f"label int, step int, h long, x {kind}")
    counts = np.zeros((2, _STEPS), dtype=np.int64)
    for r in scored.groupBy("label", "step").count().collect():  # 2 x _STEPS rows at most
        counts[r["label"], r["step"]] = r["count"]
    n_bad, n_good = counts.sum(1).tolist()
    n_good, n_bad = _wanted(n_good, n_bad, odds, most)
    chosen = F.lit(False)
    for label, n in ((1, n_good), (0, n_bad)):
        down = np.cumsum(counts[label, ::-1])
        if n and n <= down[-1]:
            # the steps above the last one as a whole; of the last one the share that is left, by the hash of the row
            last = int(np.searchsorted(down, n))
            step, share = _STEPS - 1 - last, (n - down[last] + counts[label, _STEPS - 1 - last]) / counts[label, _STEPS - 1 - last]
            in_share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))
            chosen = chosen | ((F.col("label") == label) & ((F.col("step") > step) | ((F.col("step") == step) & in_share)))
    got = scored.filter(chosen).orderBy("label", "h").select("label", "x").toArrow()
    x = got.column("x")
    if not got.num_rows:
        return (np.zeros((0, 8 + _SOURCES + 12)) if other == "m" else np.zeros((0, 16))), np.zeros(0)
    return (one_hot(_matrix(x)) if other == "m" else _matrix(x).astype(float)), np.asarray(got.column("label")).astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", surest: int = SUREST) -> CoTrained | None:
    """Co-trains on at most ``sample`` labelled documents and, of all unlabelled ones, about ``surest`` that the other view labels."""
    truth = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    truth = truth.filter(F.col("i").isNotNull())
    rows = _views(docs, [id_col]).withColumn("h", F.xxhash64("k0", "text", "m_lang", "m_source"))

    def work(batches):
        for part in chunks(batches):
            text, meta = _arrays(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("k0"), part.column("h"), pa.array(list(text.astype(np.float32))), pa.array(list(meta))], ["i", "h", "t", "m"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    seen = stored(rows.mapInArrow(work, f"i {id_type}, h long, t array<float>, m array<int>"), "features")
    known = stored(seen.select("i").distinct().join(truth, "i"), "known")
    n = known.count()
    # no more than a fifth above the sample is ordered; the hash is even over its range
    near = known.filter(F.xxhash64("i") <= int(min(1.2 * sample / n, 1.0) * (1 << 64)) - (1 << 63) - 1) if n > sample else known
    chosen = near.orderBy(F.xxhash64("i"), "i").limit(sample)
    # at most ``sample`` rows: of an id that repeats one
    got = seen.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min(F.struct("h", "t", "m")).alias("s")).select("i", "y", "s.t", "s.m").toArrow()
    if got.num_rows == 0:
        return None
    order = np.argsort(np.array(got.column("i").to_pylist()), kind="stable")
    y = np.asarray(got.column("y")).astype(float)[order]
    t, m = _matrix(got.column("t")).astype(float)[order], one_hot(_matrix(got.column("m")))[order]
    pool = stored(seen.join(truth.select("i"), "i", "left_anti").dropDuplicates(["h"]).select("h", "t", "m"), "pool")
    return _exchange(t, m, y, lambda name, view, odds: _surest(pool, name, view, odds, SURE, surest), ROUNDS)


def classify(docs: DataFrame, model: CoTrained | None, keep: list[str], prefix: str = "") -> DataFrame:
    """The columns ``keep`` of each document with text_score, meta_score, score (0 to 1, higher is better) and predicted (1: keep).

    ``prefix`` goes before these names where kept columns have them.
    """
    source = _views(docs, keep)
    names = [f"k{i}" for i in range(len(keep))]

    def work(batches):
        for part in chunks(batches):
            if model is None:
                a = b = c = np.full(part.num_rows, 0.5)
            else:
                a, b, c = model.score(*_arrays(part))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array(a), pa.array(b), pa.array(c), pa.array((c >= 0.5).astype(np.int32))],
                [*names, "text_score", "meta_score", "score", "predicted"],
            )

    fields = [T.StructField(n, source.schema[n].dataType) for n in names]
    scores = [T.StructField(n, T.DoubleType()) for n in ("text_score", "meta_score", "score")]
    done = source.mapInArrow(work, T.StructType([*fields, *scores, T.StructField("predicted", T.IntegerType())]))
    added = ("text_score", "meta_score", "score", "predicted")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *[F.col(n).alias(prefix + n) for n in added])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels), ["doc_id"])
