"""What the operators share: tables in the shared folder, bit maps of fixed size, row keys, chunks of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.session import scratch_path

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the folder that driver and executors share, and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, h): the id and text alone, whatever other columns are called, and the hash that tells apart rows of one id.

    Rows that repeat an id and its text have equal results; a null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (id, h); a null id is a value like any other."""
    return left["id"].eqNullSafe(right["id"]) & (left["h"] == right["h"])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most`` bytes of text each (one row at least), to bound a worker's memory."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def bit_map(hashes: DataFrame, col: str, per_key: int = 32, most_bits: int = 1 << 24) -> np.ndarray:
    """A bit map in which the bits of all hashes are set, as unsigned bytes; its size is a power of two up to ``most_bits``.

    Bits are joined on the executors; the driver gets one row per 64 bits that has any, which ``most_bits`` bounds.
    Other hashes may share a bit, so it serves as a filter before an exact step, or to fix an order.
    """
    n = hashes.count()
    bits = 1 << 16
    while bits < min(n * per_key, most_bits):
        bits *= 2
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    one = F.expr(f"shiftleft(1L, cast(({col} & {bits - 1}) & 63 as int))")
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("v"))
    return out.view(np.uint8)


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned 64-bit) hashes have their bit set."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit numbers over all their bits (the finisher of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, one text after the other, and where each text begins (and the end).

    Words are runs of anything but ASCII white space. A word's hash is a polynomial in its bytes, so that all words of
    all texts are hashed by running sums over the bytes.
    """
    global _POWERS
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    longest = int((ends - begins).max())
    while len(_POWERS) < longest:
        _POWERS = np.concatenate([_POWERS, _POWERS * _POWERS[-1]])
    place = np.zeros(len(data), dtype=np.int64)
    place[begins] = begins
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    place[space] = 0
    sums = np.cumsum(_BYTE[data] * _POWERS[place], dtype=np.uint64)
    hashes = mix(sums[ends - 1] - sums[begins - 1] + (ends - begins).astype(np.uint64))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return hashes, np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]) + 1)


def gram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the distinct n-grams of several texts, one text after the other, and where each text begins."""
    words, at = hashed_words(texts)
    sizes = np.diff(at)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    grams = np.zeros(starts[-1], dtype=np.uint64)
    whole = shingle_hashes(words, n) if len(words) >= n else np.zeros(0, np.uint64)
    long_ = np.flatnonzero(sizes >= n)
    place = np.repeat(at[long_] - starts[long_], counts[long_])
    target = np.repeat(starts[long_] - (np.cumsum(counts[long_]) - counts[long_]), counts[long_]) + np.arange(counts[long_].sum())
    grams[target] = whole[target + place]
    for t in np.flatnonzero((sizes > 0) & (sizes < n)):
        grams[starts[t]] = shingle_hashes(words[at[t] : at[t + 1]], n)[0]
    for a, b in zip(starts[:-1], starts[1:]):
        grams[a:b].sort()
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[1:] != grams[:-1]
    first[starts[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return grams[first], kept[starts]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; a text with fewer words has its whole sequence as one, no words none."""
    if len(words) == 0:
        return words
    n_eff = min(n, len(words))
    out = np.full(len(words) - n_eff + 1, n_eff, dtype=np.uint64)
    for i in range(n_eff):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ mix(words[i : len(words) - n_eff + 1 + i] + np.uint64(i + 1))
    return mix(out)
