"""Operator 13: hard negatives of anchors, by Fagin's threshold algorithm over sorted lists of each dimension.

Rows lie in blocks of about ``BLOCK`` rows (or ``BLOCK_CELLS`` components), dealt by the hash of the row, so neither a label nor a vector that a third of all
rows have makes a block larger. A block is one record: its rows in order of id, and for each dimension the list of its rows
sorted by that component. The blocks are written once and read by both searches.

A search takes anchors in rounds of bounded size (``ROUND_BYTES``) to every block. At an anchor, each list is read from the
end that its component's sign prefers (sorted access); every row met is scored by its integer inner product (random access).
The threshold is what a row not yet met could score at most: the sum over dimensions of the anchor's component times the
last one read. The search of a window [lo, hi] of scores may stop once the threshold falls strictly below the k-th best score
found in it, or below lo. Lists are read to depths that double, starting where the threshold first falls below all that the
windows can hold; thresholds at those depths come from one matrix product for all anchors of a round. What a task knows from
the blocks before, it keeps: the k-th best scores carry over.

First search: the positives of an anchor, the k best other rows of its label. Second search: for each positive, the k best
rows of other labels with lowest * positive <= 100 * negative <= 100 * positive.

Scores are exact whole numbers; one beyond the range of a long counts as the end of that range. Ties go to the smaller id (null last).
Rows with a null label, a null vector or a null, infinite or NaN component take no part. Shorter vectors count as zero beyond
their end. Rows that repeat id, label and vector count once; rows that share an id only are rows of their own, and other rows
to each other. Repeated vectors are rows like others. An anchor without other rows of its label has no result, nor has an
empty table. Further columns of the input are not looked at. With many dimensions of random vectors no lists can tell rows
apart, and the search reads most of a block; clustered ones stop early.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.llm.common import stored, table

POSITIVES, NEGATIVES, LOWEST = 5, 5, 80
BLOCK, BLOCK_CELLS, ROUND_BYTES, FIRST_DEPTH = 8_192, 4 << 20, 32 << 20, 16


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str, relabel=None, scale: int = 256) -> DataFrame:
    """(id, label, v, row): usable rows, vectors in whole numbers, each distinct row once."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("x"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).filter(F.forall("x", sound))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))))
    label = relabel(F.col("id"), F.col("label")) if relabel else F.col("label")
    return rows.select("id", label.alias("label"), whole.alias("v")).distinct().withColumn("row", F.xxhash64("id", "label", "v"))


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build_blocks(rows: DataFrame, dims: int, blocks: int) -> DataFrame:
    """(block, ids, labels, rows, vectors, lists): a record per block, its rows in order of id, numbers as bytes."""
    schema = "block int, ids array<long>, labels array<long>, rows array<long>, vectors binary, lists binary"

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"], na_position="last")
        x = _matrix(part["v"].tolist(), dims)
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        ids = [None if pd.isna(i) else int(i) for i in part["id"]]
        return pd.DataFrame({
            "block": [int(part["block"].iloc[0])], "ids": [ids], "labels": [part["label"].tolist()], "rows": [part["row"].tolist()],
            "vectors": [x.tobytes()], "lists": [lists.tobytes()],
        })

    dealt = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int"))
    return dealt.repartition(blocks, "block").groupBy("block").applyInPandas(build, schema)


class Anchors:
    """The anchors of a round: vectors, and per window the scores it takes and the best ones found by a task so far."""

    def __init__(self, rows: pa.Table, dims: int, k: int):
        self.vectors = _matrix(rows.column("v").to_pylist(), dims)
        self.ids, self.labels, self.rows = (rows.column(c).to_pylist() for c in ("id", "label", "row"))
        self.windows: list[list[tuple[float, float]]] = [[(-np.inf, np.inf)]] * len(self.ids)
        if "positives" in rows.column_names:
            # 80 p <= 100 s <= 100 p, in whole numbers
            self.windows = [[(-(-LOWEST * p["score"] // 100), p["score"]) for p in found] for found in rows.column("positives").to_pylist()]
        self.best = [[np.full(k, -np.inf)] * len(w) for w in self.windows]


def _read_by_depth(lists: np.ndarray, depths: list[int]) -> np.ndarray:
    """For each depth but the last and each dimension, the rows read from its list by then, a bit each."""
    dims, n = lists.shape
    read = np.zeros((dims, n), dtype=bool)
    out = np.zeros((len(depths), dims, -(-n // 8)), dtype=np.uint8)
    for level, depth in enumerate(depths[:-1]):
        read[np.arange(dims)[:, None], lists[:, :depth]] = True
        out[level] = np.packbits(read, axis=1)
    return out


def threshold_search(anchors: Anchors, labels: np.ndarray, rows: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int, same: bool):
    """(anchor, window, position, score): for each window the k best rows of the block, of the anchor's label or of others."""
    n, dims = x.shape
    largest = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)), 1)
    # doubles hold these whole numbers exactly; beyond that, numbers of any length do
    kind = np.float64 if largest(x) * largest(anchors.vectors) * max(dims, 1) < 1 << 53 else object
    x, vectors = x.astype(kind), anchors.vectors.astype(kind)
    ends = np.iinfo(np.int64)
    held = (lambda s: s) if kind is np.float64 else (lambda s: np.minimum(np.maximum(s, int(ends.min)), int(ends.max)))
    depths = [n]
    while depths[0] > FIRST_DEPTH:
        depths.insert(0, -(-depths[0] // 2))
    each, last = np.arange(dims)[:, None], np.array(depths) - 1
    # the thresholds of all anchors: each list's last component read, from the end that the anchor's sign prefers
    limits = held(np.maximum(vectors, 0) @ x[lists[:, n - 1 - last], each] + np.minimum(vectors, 0) @ x[lists[:, last], each])
    high_read, low_read = _read_by_depth(lists[:, ::-1], depths), _read_by_depth(lists, depths)
    found = []
    for a, vector in enumerate(vectors):
        windows = [(w, low, high) for w, (low, high) in enumerate(anchors.windows[a]) if low <= high]
        if not windows:
            continue
        above = max(high for _, _, high in windows)
        useful = np.flatnonzero((limits[a] < above).astype(bool))
        up, down = np.flatnonzero((vector > 0).astype(bool)), np.flatnonzero((vector < 0).astype(bool))
        fits = (labels == anchors.labels[a]) == same
        fits &= rows != anchors.rows[a]
        met = np.zeros(n, dtype=bool)
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        for level in range(useful[0] if len(useful) else len(depths) - 1, len(depths)):
            if level == len(depths) - 1:
                new = np.flatnonzero(~met & fits)
            else:
                packed = np.bitwise_or.reduce(high_read[level, up], axis=0) | np.bitwise_or.reduce(low_read[level, down], axis=0)
                seen = np.unpackbits(packed, count=n).view(bool)
                new = np.flatnonzero(seen & ~met & fits)
                met |= seen
            # many rows in a block are quicker scored in place than gathered
            got = held(x[new] @ vector if 4 * len(new) < n else (x @ vector)[new])
            at, scores = np.concatenate([at, new]), np.concatenate([scores, got])
            for w, low, high in windows:
                inside = scores[((scores >= low) & (scores <= high)).astype(bool)]
                kth = np.sort(np.concatenate([anchors.best[a][w], inside]))[-k]
                if not limits[a, level] < max(kth, low):
                    break
            else:
                break
        order = np.argsort(at)
        at, scores = at[order], scores[order]
        for w, low, high in windows:
            inside = np.flatnonzero(((scores >= low) & (scores <= high)).astype(bool))
            # rows are in order of id, so ties go to the smaller one
            inside = inside[np.argsort(-scores[inside], kind="stable")[:k]]
            anchors.best[a][w] = np.sort(np.concatenate([anchors.best[a][w], scores[inside]]))[-k:]
            found += [(a, w, int(at[i]), int(scores[i])) for i in inside]
    return found


def best_in_windows(blocks: DataFrame, anchors: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """(anchor, anchor_row, window, id, score, row): the k best rows of each block for each window of each anchor.

    Anchors go to the blocks in rounds of at most ``ROUND_BYTES``, each of them a pass over the blocks.
    """
    context = blocks.sparkSession.sparkContext
    rounds = 1 + anchors.count() * (max(dims, 1) + 32) * 8 // ROUND_BYTES
    out = None
    for number in range(rounds):
        sent = context.broadcast(anchors.filter(F.pmod(F.shiftright("row", 20), F.lit(rounds)) == number).toArrow())

        def search(batches, sent=sent):
            mine = Anchors(sent.value, dims, k)
            for batch in batches:
                for record in batch.to_pylist():
                    labels, rows = np.array(record["labels"], dtype=np.int64), np.array(record["rows"], dtype=np.int64)
                    x = np.frombuffer(record["vectors"], dtype=np.int64).reshape(len(rows), dims)
                    lists = np.frombuffer(record["lists"], dtype=np.int32).reshape(dims, len(rows))
                    found = threshold_search(mine, labels, rows, x, lists, k, same)
                    columns = [
                        pa.array([mine.ids[a] for a, _, _, _ in found], pa.int64()), pa.array([mine.rows[a] for a, _, _, _ in found], pa.int64()),
                        pa.array([w for _, w, _, _ in found], pa.int32()), pa.array([record["ids"][i] for _, _, i, _ in found], pa.int64()),
                        pa.array([s for _, _, _, s in found], pa.int64()), pa.array(rows[[i for _, _, i, _ in found]], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "anchor_row", "window", "id", "score", "row"])

        part = stored(blocks.mapInArrow(search, "anchor long, anchor_row long, window int, id long, score long, row long"), "found")
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(
    embeddings: DataFrame, is_anchor, relabel=None, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``relabel`` are functions of the columns id and (id, label).
    """
    rows = whole_vectors(embeddings, id_col, vector_col, label_col, relabel, scale)
    rows = stored(rows, "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    most = max(1, min(BLOCK, BLOCK_CELLS // max(size["dims"], 1)))
    blocks = stored(build_blocks(rows, size["dims"], 1 + size["n"] // most), "blocks")
    anchors = rows.filter(is_anchor(F.col("id")))

    best = W.orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = lambda found, *key: found.withColumn("rank", F.row_number().over(best.partitionBy(*key)))
    near = ranked(best_in_windows(blocks, anchors, size["dims"], positives, True), "anchor", "anchor_row").filter(F.col("rank") <= positives)
    grouped = near.groupBy("anchor", "anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    pairs = stored(anchors.join(grouped, (anchors["id"] == grouped["anchor"]) & (anchors["row"] == grouped["anchor_row"])).select(*anchors.columns, "positives"), "anchors")

    key = ["anchor", "anchor_row", "window"]
    hard = ranked(best_in_windows(blocks, pairs, size["dims"], negatives, False), *key).filter(F.col("rank") <= negatives)
    windows = pairs.select(F.col("id").alias("anchor"), F.col("row").alias("anchor_row"), F.posexplode("positives").alias("window", "p"))
    return windows.join(hard, key).select(
        F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(
        table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0,
        lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label),
    )


SQL = f"""
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        [floor(256 * x::double) for x in embedding] as v
    from embeddings
    where label is not null and embedding is not null
        and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select a.vec_id as anchor_id, r.vec_id as id, r.label = a.label as same, list_inner_product(a.v, r.v)::bigint as score
    from usable a cross join usable r where a.vec_id % 100 = 0 and r.vec_id <> a.vec_id
), positives as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}
), hard as (
    select p.*, s.id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank
    from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
        and {LOWEST} * p.positive_score <= 100 * s.score and s.score <= p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from hard where rank <= {NEGATIVES}
"""
