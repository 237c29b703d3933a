"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (if the vocabulary has it) and the mean of the vectors of its character trigrams. A text is
cut into overlapping windows of ``WINDOW`` words, one every ``STRIDE`` words; every window is scored, and the highest window
logit, calibrated on labelled texts, is the score of the text. Scores use nothing but the text.

Learning is bounded by parameters: the vocabulary by ``VOCABULARY``, the fit by ``PER_CLASS`` labelled texts of each class
(from each at most two windows), the calibration by ``CALIBRATION`` more. They are those with the smallest hash of their id.
Document counts of words are made on Spark, and windows are chosen inside tasks, so the driver sees only those windows:
first those with the highest sum of log-odds, in a second pass those that the network itself scores highest. Scoring covers all rows
and whole texts inside their own tasks and shuffles nothing.

Null and empty texts are scored as one window without words. Repeated rows get equal scores; ids may be null. Null labels
count as missing, labels of one id that differ are averaged (0.5 counts as 1). Without labels of both kinds every text scores 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.llm.common import chunks, table

WINDOW, STRIDE = 48, 32
VOCABULARY = 8192
PER_CLASS = 2500
CALIBRATION = 3000
WORD_DIM = CHAR_DIM = HIDDEN = 8
TRIGRAMS = 2048
_LEAST_STEPS = 200
_BATCH = 4096  # windows scored at once
_EDGE = b" .,;:!?\"'()*#$%&|-"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _starts(n: int) -> list[int]:
    """Where the windows of n words start; the last window ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Lexicon:
    """Turns words into vocabulary numbers (0: unknown) and character trigrams."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i + 1 for i, w in enumerate(words)}

    def words(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, trigrams of all words, where the trigrams of each word start)."""
        bare = [w.strip(_EDGE) or w or b" " for w in distinct]
        numbers = np.fromiter((self.number.get(w, 0) for w in bare), dtype=np.int32, count=len(bare))
        data = np.frombuffer(b"".join(b"<" + w + b">" for w in bare) + b"  ", dtype=np.uint8).astype(np.uint32)
        lengths = np.fromiter(map(len, bare), dtype=np.int64, count=len(bare)) + 2
        codes = ((data[:-2] * 65_599 + data[1:-1]) * 65_599 + data[2:]) * 2_654_435_761 >> 16
        ends = np.cumsum(lengths)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends - 1] = False
        inside[ends - 2] = False
        return numbers, (codes[inside] % TRIGRAMS).astype(np.int32), np.cumsum(lengths - 2) - (lengths - 2)


class Network:
    """The parameters and both passes of the network."""

    def __init__(self, log_odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {
            "word": f(len(log_odds) + 1, WORD_DIM) * 0.2, "char": f(TRIGRAMS, CHAR_DIM), "att": f(2 * HIDDEN), "out": f(2 * HIDDEN),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = np.clip(log_odds, -3, 3)
        for d in "fb":
            self.p |= {f"W{d}": f(WORD_DIM + CHAR_DIM, 3 * HIDDEN) * 2, f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, lexicon: tuple) -> np.ndarray:
        """Input vectors of distinct words."""
        numbers, trigrams, starts = lexicon
        counts = np.diff(np.append(starts, len(trigrams)))[:, None]
        chars = np.add.reduceat(self.p["char"][trigrams], starts, axis=0) / counts
        return np.hstack([self.p["word"][numbers], chars]).astype(np.float32)

    def _run(self, d: str, gates: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: list | None):
        """Hidden states of one direction, in text order; ``gates`` are the input parts of distinct words."""
        p, n, t = self.p, len(codes), codes.shape[1]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((t, n, HIDDEN), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            x, hu, m = gates[codes[:, s]], h @ p[f"U{d}"], mask[:, s : s + 1]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN] * m, zr[:, HIDDEN:]
            c = 2 * _sigmoid(2 * (x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])) - 1
            if keep is not None:
                keep.append((s, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = h + z * (c - h)
            out[s] = h
        return out

    def forward(self, x: np.ndarray, codes: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``codes`` (windows, words) index the rows of ``x``."""
        p = self.p
        mask = (np.arange(codes.shape[1]) < lengths[:, None]).astype(np.float32)
        states = []
        for d in "fb":
            trace: list | None = [] if keep is not None else None
            states.append(self._run(d, x @ p[f"W{d}"] + p[f"c{d}"], codes, mask, trace))
            if keep is not None:
                keep[d] = trace
        h = np.concatenate(states, axis=2)
        e = h @ p["att"] + (mask.T - 1) * 1e4
        a = np.exp(e - e.max(0))
        a *= mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "pooled": pooled, "mask": mask}
        return pooled @ p["out"] + p["bias"][0]

    def backward(self, x: np.ndarray, codes: np.ndarray, keep: dict, dlogit: np.ndarray, lexicon: tuple) -> dict:
        p, g = self.p, {}
        h, a = keep["h"], keep["a"]
        g["out"], g["bias"] = keep["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dpooled, h)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnh->h", de, h)
        dh_all = a[:, :, None] * dpooled + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            carry = np.zeros((len(codes), HIDDEN), np.float32)
            g[f"U{d}"], dgates = np.zeros_like(p[f"U{d}"]), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for s, before, z, r, c, hun, m in reversed(keep[d]):
                dh = dh_all[s, :, i * HIDDEN : (i + 1) * HIDDEN] + carry
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z) * m
                dr = dc * hun * r * (1 - r)
                dhu = np.hstack([dz, dr, dc * r])
                carry = dh * (1 - z) + dhu @ p[f"U{d}"].T
                g[f"U{d}"] += before.T @ dhu
                np.add.at(dgates, codes[:, s], np.hstack([dz, dr, dc]))
            g[f"W{d}"], g[f"c{d}"] = x.T @ dgates, dgates.sum(0)
            dx += dgates @ p[f"W{d}"].T
        numbers, trigrams, starts = lexicon
        counts = np.diff(np.append(starts, len(trigrams)))
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], numbers, dx[:, :WORD_DIM])
        g["word"][0] = 0
        np.add.at(g["char"], trigrams, np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0))
        return g

    def train(self, lexicon: Lexicon, windows: list[list[bytes]], y: np.ndarray, epochs: int, seed: int = 11, rate: float = 0.01):
        """Adam on the cross entropy of windows; each class weighs the same."""
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(windows))
            for at in range(0, len(order), 128):
                rows = order[at : at + 128]
                distinct, codes, lengths = _coded([windows[i] for i in rows])
                lex = lexicon.words(distinct)
                x, keep = self.inputs(lex), {}
                p = _sigmoid(self.forward(x, codes, lengths, keep))
                grads = self.backward(x, codes, keep, ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32), lex)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    now = rate * (0.5 if epoch >= epochs // 2 else 1)
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        return self


def _coded(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, windows as their numbers (padded by 0), and window lengths."""
    at: dict[bytes, int] = {b"": 0}
    codes = np.zeros((len(windows), WINDOW), np.int32)
    for i, w in enumerate(windows):
        codes[i, : len(w)] = [at.setdefault(x, len(at)) for x in w]
    return list(at), codes, np.array([len(w) for w in windows])


class Scorer:
    """A trained network with its lexicon and calibration."""

    def __init__(self, lexicon: Lexicon, network: Network, scale: tuple[float, float] = (1.0, 0.0)):
        self.lexicon, self.network, self.scale = lexicon, network, scale

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit of each text, and the word at which that window starts."""
        at: dict[bytes, int] = {b"": 0}
        flat, first, length, owner = [], [], [], []
        base = 0
        for i, words in enumerate(texts):
            flat.append(np.fromiter((at.setdefault(w, len(at)) for w in words), dtype=np.int32, count=len(words)))
            for s in _starts(len(words)):
                first.append(base + s)
                length.append(min(WINDOW, len(words)))
                owner.append(i)
            base += len(words)
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        flat = np.concatenate([*flat, np.zeros(WINDOW, np.int32)])
        x = self.network.inputs(self.lexicon.words(list(at)))
        first, length, owner = np.array(first), np.array(length), np.array(owner)
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), _BATCH):
            part = slice(i, i + _BATCH)
            out[part] = self.network.forward(x, flat[first[part, None] + np.arange(WINDOW)], length[part])
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        best = np.maximum.reduceat(out, begin)
        where = np.full(len(texts), len(out))
        np.minimum.at(where, owner, np.where(out == best[owner], np.arange(len(out)), len(out)))
        base_of = np.concatenate([[0], np.cumsum([len(w) for w in texts])[:-1]]).astype(np.int64)
        return best.astype(float), first[where] - base_of

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.logits(texts)[0] + self.scale[1])


def _windows(rows: DataFrame, choose) -> tuple[list[list[bytes]], np.ndarray]:
    """Windows that ``choose(words)`` starts at, of all texts, and their labels."""

    def work(batches):
        for part in chunks(batches):
            found, y = [], []
            for text, label in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                words = words_of(text)
                for s in sorted(set(choose(words))):
                    found.append(b" ".join(words[s : s + WINDOW]))
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(y, pa.int32())], ["w", "y"])

    got = rows.mapInArrow(work, "w binary, y int").toArrow()
    pairs = sorted(zip(got.column("w").to_pylist(), got.column("y").to_pylist()))
    return [w.split() for w, _ in pairs], np.array([y for _, y in pairs], dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id") -> Scorer | None:
    """Learns from the labels of rows for which ``usable`` (a condition on the id column ``i``) holds."""
    truth = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    truth = truth.filter(F.col("i").isNotNull() & usable)
    order = [F.xxhash64("i", F.lit("toxicity")), F.col("i")]
    share = F.pmod(F.xxhash64("i", F.lit("share")), F.lit(4)) == 0  # a quarter is kept for the calibration
    fitting = truth.filter(~share)
    chosen = fitting.filter("y = 1").orderBy(*order).limit(PER_CLASS).unionByName(fitting.filter("y = 0").orderBy(*order).limit(PER_CLASS))
    text = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(chosen), "i")  # at most 2 x PER_CLASS rows

    def presence(batches):
        for part in chunks(batches):
            w, y = [], []
            for t, label_ in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                distinct = {x.strip(_EDGE) or x for x in words_of(t)}
                w.extend(distinct)
                y.extend([label_] * len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.int32())], ["w", "y"])

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    counts = rows.select("text", "y").mapInArrow(presence, "w binary, y int").groupBy("w").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")
    )
    lift = F.log((F.col("a") + 0.5) / (sizes[1] + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
    vocabulary = (
        counts.filter((F.col("a") + F.col("b") >= 3) & (F.length("w") <= 64)).withColumn("lift", lift)
        .orderBy(F.desc(F.abs("lift") * F.sqrt(F.col("a") + F.col("b"))), "w").limit(VOCABULARY).select("w", "lift").toArrow()
    )
    words, lifts = vocabulary.column("w").to_pylist(), np.asarray(vocabulary.column("lift"))
    by_word = dict(zip(words, np.where(np.abs(lifts) > 1, lifts, 0).tolist()))

    def by_odds(found: list[bytes]) -> list[int]:
        """The window with the highest sum of log-odds, and one that the text itself picks."""
        starts = _starts(len(found))
        total = np.concatenate([[0.0], np.cumsum([max(0.0, by_word.get(w.strip(_EDGE), 0.0)) for w in found])])
        sums = [total[min(s + WINDOW, len(found))] - total[s] for s in starts]
        return [starts[int(np.argmax(sums))], starts[len(found) % len(starts)]]

    lexicon = Lexicon(words)
    network = Network(lifts)
    # a toxic text need not be toxic everywhere: only its strongest window is an example of the class
    windows, y = _windows(rows, by_odds)
    strong, sy = _windows(rows.filter("y = 1"), lambda w: by_odds(w)[:1])
    calm, cy = [w for w, k in zip(windows, y) if k == 0], [0.0 for k in y if k == 0]
    epochs = max(4, -(-_LEAST_STEPS * 128 // (len(strong) + len(calm))))  # few examples are gone through more often
    network.train(lexicon, strong + calm, np.array([*sy, *cy], np.float32), epochs=epochs)
    first = Scorer(lexicon, network)
    windows, y = _windows(rows, lambda w: [int(first.logits([w])[1][0])])
    network.train(lexicon, windows + calm, np.array([*y, *cy], np.float32), epochs=3, seed=12, rate=0.004)

    aside = text.join(F.broadcast(truth.filter(share).orderBy(*order).limit(CALIBRATION)), "i")
    scorer = Scorer(lexicon, network)

    def raw(batches):
        for part in chunks(batches):
            logit, _ = scorer.logits([words_of(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(logit), part.column("y")], ["logit", "y"])

    got = aside.select("text", "y").mapInArrow(raw, "logit double, y int").toArrow()
    z, t = np.asarray(got.column("logit"), dtype=float), np.asarray(got.column("y"), dtype=float)
    if len(set(t)) == 2:
        x = np.column_stack([z, np.ones(len(z))])
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = _sigmoid(x @ w)
            h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag([0.05, 1e-6])
            w += np.clip(np.linalg.solve(h, x.T @ (t - p) - np.array([0.05, 0]) * (w - np.array([1.0, 0]))), -1, 1)
        scorer.scale = (max(float(w[0]), 1e-3), float(w[1]))
    return scorer


def score(docs: DataFrame, scorer: Scorer | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each document with its score (0 to 1, higher: more likely toxic) and predicted (1 from 0.5 on)."""
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches):
        for part in chunks(batches, most=2 << 20):
            texts = part.column("text").to_pylist()
            s = np.full(len(texts), 0.5) if shared.value is None else shared.value.score([words_of(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in names], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"]
            )

    fields = [T.StructField(n, source.schema[n].dataType) for n in names]
    done = source.mapInArrow(work, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "score", "predicted")


def _remainder(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = score(docs, fit(docs, labels, usable=_remainder("i") != 0), ["doc_id"])
    return done.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
