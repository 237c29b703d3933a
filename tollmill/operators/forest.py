"""An isolation forest whose trees are rows, and whose scores are whole numbers.

Trees are grown over one bounded sample: the ``trees * size`` rows with the smallest digest of their key, dealt to the trees
in circular order, so trees share rows only where the table is smaller than that. A tree has ``size`` rows at most and
log2(size) levels; all trees grow together, a level a round. A node takes the first feature that is not constant in it,
beginning with one drawn by digest, and cuts it at a drawn share of its range. Nothing depends on how rows are partitioned.

The length of a row's way to its leaf, plus the mean way that would be left among the leaf's rows, is kept in millionths, so
sums over trees are exact. Short ways mean odd rows. Rows walk through the trees in numpy, batch by batch where they are:
as list functions the same steps are interpreted one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tollmill.operators.profiling import exact_percentiles, unpivot
from tollmill.functions.cleaning import stable_uniform
from tollmill.session import freeze

TREES, SIZE, UNIT = 100, 256, 1_000_000
_CHUNK = 500  # rows that walk together, so that their nodes stay in the processor's cache


def mean_way(n: int) -> int:
    """Mean way of an unsuccessful search among n rows, in millionths."""
    return 0 if n < 2 else round(UNIT * (2 * math.fsum(1 / i for i in range(1, n)) - 2 * (n - 1) / n))


def draw_samples(rows: DataFrame, key: str, features: list[str], trees: int = TREES, size: int = SIZE, seed: int = 42) -> DataFrame:
    """(tree, x): the rows of each tree, as arrays of their features."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    drawn = rows.select(stable_uniform(seed, F.col(key)).alias("u"), F.col(key).cast("string").alias("k"), x.alias("x"))
    drawn = drawn.orderBy("u", "k", "x").limit(trees * size)
    # a bounded number of rows, so one window holds them
    ranked = freeze(drawn.select("x", (F.row_number().over(W.orderBy("u", "k", "x")) - 1).alias("r")))
    n = ranked.count()
    starts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), F.floor(t * F.lit(n) / F.lit(trees)).alias("s")))
    mine = F.filter(starts, lambda t: F.pmod(F.col("r") - t["s"], F.lit(max(n, 1))) < min(size, n))
    return ranked.select(F.explode(mine).alias("m"), "x").select(F.col("m.t").alias("tree"), "x")


def grow(samples: DataFrame, width: int, size: int = SIZE, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, way): the nodes of all trees; 1 is a root, 2n and 2n + 1 are below n. A leaf's feature is -1."""
    deepest = max(1, math.ceil(math.log2(size)))
    ways = F.array(*[F.lit(mean_way(n)).cast("long") for n in range(size + 1)])
    rows, done = samples.withColumn("node", F.lit(1)), None
    for level in range(deepest + 1):
        low = F.array(*[F.min(F.col("x")[i]) for i in range(width)])
        high = F.array(*[F.max(F.col("x")[i]) for i in range(width)])
        nodes = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).cast("int").alias("n"), low.alias("low"), high.alias("high"))
        first = F.floor(stable_uniform(seed + 1, F.col("tree"), F.col("node")) * width).cast("int")
        turned = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i + F.col("first")) % width)
        spread = F.filter(turned, lambda f: F.col("low")[f] < F.col("high")[f])
        feature = F.coalesce(F.try_element_at(spread, F.lit(1)), F.lit(-1)) if level < deepest else F.lit(-1)
        nodes = nodes.withColumn("first", first).withColumn("feature", feature)
        at = F.col("low")[F.col("feature")] + stable_uniform(seed + 2, F.col("tree"), F.col("node")) * (F.col("high")[F.col("feature")] - F.col("low")[F.col("feature")])
        nodes = freeze(nodes.select(
            "tree", "node", "feature", F.when(F.col("feature") >= 0, at).alias("cut"), (ways[F.col("n")] + level * UNIT).alias("way")
        ))
        done = nodes if done is None else done.unionByName(nodes)
        if level < deepest:
            split = nodes.filter("feature >= 0").drop("way")
            right = F.when(F.col("x")[F.col("feature")] >= F.col("cut"), 1).otherwise(0)
            # nodes of bounded samples: fewer than trees * size
            rows = freeze(rows.join(F.broadcast(split), ["tree", "node"]).select("tree", (F.col("node") * 2 + right).alias("node"), "x"))
    return done


def as_arrays(nodes: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The forest as tables of tree and node: features, cuts and, for the deepest level, ways.

    It holds ``2 * trees * size`` nodes at most, whatever the table's size. Every way is led down to the deepest level: both
    sides of a leaf have its way, so a walk has the same steps for every row and tree. A node that no sample reached is a leaf.
    """
    found = nodes.collect()
    deepest = max(1, math.ceil(math.log2(size)))
    shape = (max((r["tree"] for r in found), default=-1) + 1, 2 << deepest)
    feature, cut, way = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, np.int64)
    known, leaf = np.zeros(shape, bool), np.ones(shape, bool)
    for r in found:
        at = r["tree"], r["node"]
        known[at], way[at], leaf[at] = True, r["way"], r["feature"] < 0
        if r["feature"] >= 0:
            feature[at], cut[at] = r["feature"], r["cut"]
    for node in range(2, shape[1]):
        above, level = node // 2, node.bit_length() - 1
        way[:, node] = np.where(leaf[:, above], way[:, above], np.where(known[:, node], way[:, node], level * UNIT))
    return feature, cut, way[:, shape[1] // 2:]


def with_way(df: DataFrame, forest: tuple[np.ndarray, np.ndarray, np.ndarray], features: list[Column], name: str) -> DataFrame:
    """Adds the summed length of each row's ways through all trees. Batches of rows take one step in all trees at a time."""
    feature, cut, way = forest
    trees, leaves = way.shape
    width, steps = len(features), leaves.bit_length() - 1

    def summed(x: np.ndarray) -> np.ndarray:
        """The ways of rows whose features are the columns of x; nodes are numbered through all trees."""
        n = x.shape[1]
        column = (np.arange(trees) * (2 * leaves))[:, None]
        features, cuts, ways, values, row = feature.ravel() * n, cut.ravel(), way.ravel(), x.ravel(), np.arange(n)
        node = np.ones((trees, n), np.int64)
        for _ in range(steps):
            at = node + column
            place = features.take(at)
            place += row
            node *= 2
            node += values.take(place) >= cuts.take(at)
        node += (np.arange(trees) * leaves - leaves)[:, None]
        return ways.take(node).sum(axis=0)

    def walk(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            sums = [summed(np.ascontiguousarray(x[:, i : i + _CHUNK])) for i in range(0, x.shape[1], _CHUNK)]
            total = pa.array(np.concatenate([np.zeros(0, np.int64), *sums]))
            yield pa.RecordBatch.from_arrays([*batch.columns[width:], total], names=names)

    names = [*df.columns, name]
    rows = df.select(*[f.cast("double").alias(f"_x{i}") for i, f in enumerate(features)], *df.columns)
    return rows.mapInArrow(walk, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def isolation_anomaly(
    df: DataFrame, ref: DataFrame, features: dict[str, Column], key: str, contamination: float = 0.1, trees: int = TREES, size: int = SIZE, seed: int = 42,
    way: str | None = None,
) -> DataFrame:
    """Marks rows with shorter ways than all but ``contamination`` of the reference has: ``isolation_score`` (0 to 1, odd rows
    higher) and ``isolation_anomalous``. A reference without rows marks nothing. ``way`` names a column for the length itself.

    NULL or NaN features count as zero. Samples are drawn from the whole reference; the limit is taken over all its rows.
    """
    sound = {f"_f{i}": F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(features.values())}
    numbers = ref.select(F.col(key).alias("_key"), *[c.alias(n) for n, c in sound.items()])
    samples = draw_samples(numbers, "_key", list(sound), trees, size, seed)
    forest = as_arrays(grow(samples, len(sound), size, seed), size)
    known = freeze(with_way(numbers, forest, [F.col(n) for n in sound], "_way").select("_way"))
    limit = exact_percentiles(unpivot(known, {"way": F.col("_way").cast("double")}, "double"), [contamination]).select("percentile").scalar()
    scored = with_way(df, forest, list(sound.values()), "_way").withColumn("_limit", limit)
    mean = F.lit(float(max(1, mean_way(size)) * trees))
    kept = scored.withColumn(way, F.col("_way")) if way else scored
    return kept.withColumns({
        "isolation_score": F.pow(F.lit(2.0), -F.col("_way") / mean), "isolation_anomalous": F.coalesce(F.col("_way") < F.col("_limit"), F.lit(False)),
    }).drop("_way", "_limit")
