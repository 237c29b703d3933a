"""Operator 1: benchmark decontamination by spaced seeds.

Words are compared in lower case without ASCII punctuation. A seed is the hash of the words at the ones of a fixed mask;
words at its zeros are ignored, so a seed survives substitutions there. Seeds of benchmark items and of all places of all
documents are joined; around each hit the words of document and item are laid side by side on the hit's diagonal, and the
stretch with the most agreeing words is kept in which at least ``identity`` of the words agree. Stretches on several
diagonals (a word put in or left out) add up. A document leaks an item if at least ``min_words`` words agree, or
``identity`` of the item (but ``SHORTEST`` words) if that is less.

The masks have five ones each and leave no gap: whichever words are replaced, a stretch of one diagonal that meets these
bars at the default values has a seed in it (a test goes through all cases). Items with fewer than ``SHORTEST`` words cannot
be told from chance and are not looked for, nor are null or empty ones. Items with the same words are one: the smallest id
stands for them. Null and empty texts leak nothing; an empty table on either side gives an empty
result. Rows that repeat an id give one row per item: the best.

Documents are read once, as a whole, and only the words around places whose seed has its bit set in a bit map of the
benchmark's seeds (of bounded size) leave the task; the exact join follows. The benchmark is broadcast only while its
seeds and words are below ``MOST_SEEDS`` and ``MOST_WORDS``; beyond, the same joins are shuffled, and Spark splits hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.common import bit_map, chunks, hashed_words, in_bit_map, keyed, mix, stored, table

# --- fixed values: seeds of five words over five to ten places ---
MASKS = ("11111", "111101", "111011", "110111", "101111", "1110011", "1101011", "11100101", "11001011", "1101000011")
# --- end of fixed values ---
SHORTEST = 5
MIN_WORDS = 13
IDENTITY = 0.75
MOST_SEEDS = 1_000_000
MOST_WORDS = 2_000_000
_SLICE = 1 << 20
_SPLIT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """A text in lower case with white space for ASCII punctuation, as UTF-8."""
    return text.lower().encode().translate(_SPLIT)


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of a mask at all places of a text, given the hashes of its words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words): one row per distinct sequence of words, as hashes."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def work(batches):
        for part in chunks(batches, most=_SLICE):
            words, begin = hashed_words([plain(t) for t in part.column("text").to_pylist()])
            hashed = np.split(words.view(np.int64), begin[1:-1])
            yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(hashed, pa.list_(pa.int64()))], ["item", "words"])

    kind = rows.schema["item"].dataType.simpleString()
    hashed = rows.mapInArrow(work, f"item {kind}, words array<bigint>").filter(F.size("words") >= SHORTEST)
    return hashed.groupBy("words").agg(F.min("item").alias("item"))


def _seeds(items: DataFrame) -> DataFrame:
    """(seed, item, at): each seed of each item once, at its first place."""

    def work(batches):
        for batch in batches:
            item, seed, at = [], [], []
            for i, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                hashed = np.array(words, dtype=np.int64).view(np.uint64)
                for mask in MASKS:
                    found, first = np.unique(seeds_of(hashed, mask), return_index=True)
                    item += [i] * len(found)
                    seed += found.view(np.int64).tolist()
                    at += first.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(item, batch.schema.field("item").type), pa.array(at, pa.int32())], ["seed", "item", "at"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(work, f"seed long, item {kind}, at int")


def agreement(doc: np.ndarray, item: np.ndarray, shifts: list[int], identity: float) -> tuple[int, int, int, int]:
    """(agreeing words, places compared, first and last word of the document) of the best stretches on the given diagonals.

    Word i of the item lies beside word i + shift of the document. Of the stretches in which ``identity`` of the words
    agree, the one with the most agreeing words counts, and of equal ones the shortest.
    """
    agrees = np.zeros(len(item), dtype=bool)
    covers = np.zeros(len(item), dtype=bool)
    first, last = len(doc), -1
    for shift in shifts:
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        if a >= b:
            continue
        same = item[a:b] == doc[a + shift : b + shift]
        if same.sum() < SHORTEST:
            continue
        count = np.concatenate([[0], np.cumsum(same)])
        sums = np.round(count - identity * np.arange(len(count)), 9)
        # the earliest begin from which a stretch up to each end has its share, moved on to its first agreeing word
        begins = np.searchsorted(-np.minimum.accumulate(sums), -sums)
        places = np.flatnonzero(same)
        begins = np.minimum(places[np.minimum(count[begins], len(places) - 1)], np.arange(len(count)))
        agreeing = count - count[begins]
        ends = np.flatnonzero(agreeing == agreeing.max())
        end = int(ends[np.argmin(ends - begins[ends])])
        begin = int(begins[end])
        if same[begin:end].sum() < SHORTEST:
            continue
        agrees[a + begin : a + end] |= same[begin:end]
        covers[a + begin : a + end] = True
        first, last = min(first, a + begin + shift), max(last, a + end + shift - 1)
    return int(agrees.sum()), int(covers.sum()), first, last


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id_col, item_col, n_matched, n_compared, first_word, last_word): one row per document and item that it leaks."""
    items = stored(_items(benchmark, item_col, item_text), "items")
    stats = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")).first()
    seeds = stored(_seeds(items), "seeds")
    n_seeds, reach = seeds.count(), int(stats["longest"])
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(seeds, "seed", per_key=2048, most_bits=1 << 27))
    texts = keyed(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def find(batches):
        """The words around places whose seed may be one of the benchmark's, overlapping stretches joined."""
        for part in chunks(batches, most=_SLICE):
            out: dict[str, list] = {k: [] for k in ("row", "start", "words", "hits")}
            everything, begin = hashed_words([plain(t) for t in part.column("text").to_pylist()])
            places, found = [], []
            for mask in MASKS:
                s = seeds_of(everything, mask)
                at = np.flatnonzero(in_bit_map(bits.value, s))
                at = at[np.searchsorted(begin, at, "right") == np.searchsorted(begin, at + len(mask) - 1, "right")]  # inside one text
                places.append(at)
                found.append(s[at])
            all_at, all_s = np.concatenate(places), np.concatenate(found)
            order = np.argsort(all_at, kind="stable")
            all_at, all_s = all_at[order], all_s[order].view(np.int64)
            owner = np.searchsorted(begin, all_at, "right") - 1
            for row in np.unique(owner).tolist():
                mine = owner == row
                at, s = all_at[mine] - begin[row], all_s[mine]
                words = everything[begin[row] : begin[row + 1]]
                for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                    start, end = max(0, at[group[0]] - reach), min(len(words), at[group[-1]] + reach + 1)
                    out["row"].append(row)
                    out["start"].append(int(start))
                    out["words"].append(words[start:end].view(np.int64))
                    out["hits"].append([{"seed": int(x), "place": int(p - start)} for x, p in zip(s[group], at[group])])
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(rows), part.column("h").take(rows), pa.array(out["start"], pa.int32()),
                 pa.array(out["words"], pa.list_(pa.int64())),
                 pa.array(out["hits"], pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())])))],
                ["id", "h", "start", "words", "hits"],
            )

    near = stored(
        texts.mapInArrow(find, f"id {kind}, h long, start int, words array<bigint>, hits array<struct<seed:bigint, place:int>>"), "near"
    ).withColumn("key", F.xxhash64("id", "h", "start"))
    hits = near.select("key", F.explode("hits").alias("hit")).select("key", "hit.seed", "hit.place")
    shared = F.broadcast(seeds) if n_seeds <= MOST_SEEDS else seeds
    pairs = hits.join(shared, "seed").groupBy("key", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    own = items.withColumnRenamed("words", "item_words")
    own = F.broadcast(own) if int(stats["words"]) <= MOST_WORDS else own
    beside = near.select("key", "id", "start", "words").join(pairs, "key").join(own, "item").select("id", "start", "words", "item", "item_words", "shifts")

    def verify(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [
                    agreement(np.array(w), np.array(i), sorted(s), identity)
                    for w, i, s in zip(*(part.column(c).to_pylist() for c in ("words", "item_words", "shifts")))
                ]
                share = np.ceil(np.round(identity * pc_lengths(part.column("item_words")), 9))
                need = np.minimum(min_words, np.maximum(SHORTEST, share))
                kept = [k for k, r in enumerate(rows) if r[0] >= need[k]]
                at = pa.array(kept, pa.int64())
                start = part.column("start").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("item").take(at), pa.array([rows[k][0] for k in kept], pa.int32()),
                     pa.array([rows[k][1] for k in kept], pa.int32()), pa.array([start[k] + rows[k][2] for k in kept], pa.int32()),
                     pa.array([start[k] + rows[k][3] for k in kept], pa.int32())],
                    ["id", "item", "n_matched", "n_compared", "first_word", "last_word"],
                )

    item_kind = items.schema["item"].dataType.simpleString()
    found = beside.mapInArrow(verify, f"id {kind}, item {item_kind}, n_matched int, n_compared int, first_word int, last_word int")
    best = F.max(F.struct("n_matched", -F.col("n_compared"), -F.col("first_word"), "last_word")).alias("m")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "m.n_matched", (-F.col("m.col2")).alias("n_compared"),
        (-F.col("m.col3")).alias("first_word"), "m.last_word",
    )


def pc_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.list_value_length(column))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
