"""Operator 10: exact Jaccard join on word n-grams by T-occurrence search, and the groups its links make.

Two documents link if 100 * |intersection| >= ``percent`` * |union| of their sets of n-grams. A partner of a set with n
members shares at least T = ceil(percent * n / 100) of them. DivideSkip sets aside L of the inverted lists of a set, the
long ones, and merges the short ones; a partner occurs in at least T - L of them. With L = T - 1 the n - T + 1 shortest lists
have to show a partner once. So:

1. n-grams are counted over all documents, by keys that grow with their number, so that few share one by chance. Bit maps of bounded
   size tell the level of an n-gram: 0 if one set has it, 1 if two have, and so on. n-grams that share a bit with one of a higher level
   count as that level, which changes costs, not results;
2. the front of a distinct set are its first n - T + 1 n-grams in the order of (level, hash). Two sets that link share an n-gram in their
   fronts, and it has level 1 or more; so only those go to the index, and only from sets that some different set could link with (a smaller
   one than 100 n >= percent (n + 1) can not). The smaller of two sets that link shares at least 2 percent n / (100 + percent), so it has the
   n-gram in a still shorter, inner front. Sets that meet in a list and whose sizes allow a link are candidates, joined by a chain, not by pairs;
3. candidates come together in groups (connected parts). In a group the full inverted lists are at hand, and each set is searched
   by DivideSkip: the short lists are merged into counts, what reached T - L is probed in the long lists by binary search.
   Sets already known to be connected need no search among each other; so a group of near copies costs a few searches;
4. groups beyond ``BLOCK`` n-grams are cut into blocks by size and hash, and all pairs of blocks whose sizes allow links are
   searched, each in its own task.

Words are runs of anything but ASCII white space, A-Z in lower case. A text with fewer than n words has its whole sequence as
its only n-gram; texts without words (and null texts) have none and link with nothing. Equal sets are one node, so copies
cost nothing. Repeated rows are linked like copies; a null id takes part and is never the smallest. An empty table gives an
empty result. N-grams are compared by 64-bit hashes, sets named by 64-bit hashes of all their n-grams.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.llm.common import bit_map, chunks, gram_sets, in_bit_map, keyed, mix, stored, table
from tollmill.llm.components import components

#: N-grams in two sets or more have level 1, those in ``LONG`` sets level 2, and each further level takes four times as many.
LONG = 4
#: By how many powers of two the bit map of each level is smaller than the first one, which has a bit for four n-grams.
SMALLER = (0, 3, 5, 7, 9)
MAP_BITS = 1 << 28
#: Largest bit map of the sets that are searched.
NODE_BITS = 1 << 26
BLOCK = 4_000_000
#: N-grams a bucket of the index holds about, with copies.
BUCKET = 8_000_000
_CHUNK = 16 << 20
_SLICE = 1 << 20


def _pack(numbers: np.ndarray, level: int = 1) -> bytes:
    """Unsigned 64-bit numbers as eight compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def _pack_sorted(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def names_of(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set; 0 for the empty one."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        mixed = mix(grams)
        out[full] = mix(np.bitwise_xor.reduceat(mixed, at[full]) + np.add.reduceat(mixed, at[full]) + np.diff(at)[full].astype(np.uint64))
    return out


def _grams(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, where each text begins, names) of a slice."""
    grams, at = gram_sets([t.encode().lower() for t in part.column("text").to_pylist()], n)
    return grams, at, names_of(grams, at)


def _sets(part: pa.RecordBatch, n: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct sets of a slice with their names, those that have words and are ``wanted``."""
    grams, at, names = _grams(part, n)
    ok = np.diff(at) > 0
    if wanted is not None:
        ok &= in_bit_map(wanted, names)
    distinct, first = np.unique(names, return_index=True)
    for i in first[ok[first]].tolist():
        yield int(names[i]), grams[at[i] : at[i + 1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _by_bucket(keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys of so many bits, one per bucket of equal ranges of keys."""
    bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _key_bits(grams: int) -> int:
    """Bits of a hash by which n-grams are counted: of so many grams, one in 64 shares its key with another by chance."""
    return min(64, max(32, grams.bit_length() + 6))


def levels_of(grams: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """In how many of the maps, one after the other, each n-gram has its bit; 0 if it occurs in one set only."""
    out = np.zeros(len(grams), dtype=np.uint8)
    at = np.arange(len(grams))
    for bits in maps:
        place = grams[at] >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        at = at[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[at] += 1
    return out


def level_maps(texts: DataFrame, n: int, grams: int, buckets: int, most_bits: int = MAP_BITS) -> list[np.ndarray]:
    """For each level a bit map of the n-grams that reach it, addressed by the first bits of their hash.

    A bucket is a range of hashes, so its task has a piece of each map; the driver gets the pieces, which ``most_bits`` bounds.
    """
    key_bits = _key_bits(grams)
    first = min(most_bits, max(1 << 16, 1 << (grams // 4).bit_length()))
    sizes = [max(1 << 16, first >> less) for less in SMALLER]
    least = [2, *(LONG << 2 * i for i in range(len(SMALLER) - 1))]

    def send(batches):
        for block in chunks(batches, most=_CHUNK):
            sets = [g for part in chunks([block], most=_SLICE) for _, g in _sets(part, n)]
            if not sets:
                continue
            keys = np.sort(np.concatenate(sets) >> np.uint64(64 - key_bits))
            rows = [(b, _pack_sorted(keys[s])) for b, s in _by_bucket(keys, key_bits, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["bucket", "grams"])

    def count(pdf):
        import pandas as pd
        import zstandard

        keys, times = np.unique(np.concatenate([_unpack_sorted(d) for d in pdf["grams"]]), return_counts=True)
        out = []
        for level, bits in enumerate(sizes):
            keys, times = keys[times >= least[level]], times[times >= least[level]]
            if len(keys):
                at = (keys >> np.uint64(key_bits - bits.bit_length() + 1)).astype(np.int64)
                begin = int(at[0]) >> 3
                piece = np.zeros(((int(at[-1]) >> 3) - begin + 1) * 8, dtype=bool)
                piece[at - begin * 8] = True
                out.append((level, begin, zstandard.ZstdCompressor(level=1).compress(np.packbits(piece, bitorder="little").tobytes())))
        return pd.DataFrame(out, columns=["level", "begin", "bits"])

    import zstandard

    maps = [np.zeros(bits // 8, dtype=np.uint8) for bits in sizes]
    found = texts.mapInArrow(send, "bucket int, grams binary").groupBy("bucket").applyInPandas(count, "level int, begin long, bits binary").toArrow()
    for level, begin, piece in zip(*(found.column(c) for c in ("level", "begin", "bits"))):
        piece = np.frombuffer(zstandard.ZstdDecompressor().decompress(piece.as_py()), dtype=np.uint8)
        begin = begin.as_py()
        maps[level.as_py()][begin : begin + len(piece)] |= piece
    return maps


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """Roots of 0..n-1 joined by pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.fromiter(map(find, range(n)), dtype=np.int64, count=n)


def candidates(texts: DataFrame, n: int, percent: int, maps, buckets: int) -> DataFrame:
    """(u, v): edges between the names of sets that meet in an inverted list of the index, each to the next smaller set that can link."""

    def send(batches):
        for block in chunks(batches, most=_CHUNK):
            grams, names, sizes = [], [], []
            for part in chunks([block], most=_SLICE):
                flat, at, called = _grams(part, n)
                size = np.diff(at)
                can = (size > 0) & (100 * size >= percent * (size + 1))
                if not can.any():
                    continue
                levels = levels_of(flat, maps.value)
                alone = np.concatenate([[0], np.cumsum(levels == 0)])
                front = size - (percent * size + 99) // 100 + 1
                # a partner shares one of the front n-grams; no other set has those of level 0
                ok = can & (alone[at[1:]] - alone[at[:-1]] < front)
                _, first = np.unique(called, return_index=True)
                for i in first[ok[first]].tolist():
                    own = np.argsort(levels[at[i] : at[i + 1]], kind="stable")[: front[i]] + at[i]
                    place = np.flatnonzero(levels[own])
                    # a partner of the same size or a larger one shares one of the inner ones
                    inner = place < size[i] - (2 * percent * size[i] + 99 + percent) // (100 + percent) + 1
                    grams.append(flat[own[place]])
                    names.append(np.full(len(place), called[i], np.uint64))
                    sizes.append(np.uint64(2 * size[i]) + inner.astype(np.uint64))
            if not grams:
                continue
            grams = np.concatenate(grams)
            order = np.argsort(grams, kind="stable")
            grams, names, sizes = grams[order], np.concatenate(names)[order], np.concatenate(sizes)[order]
            rows = [(b, _pack_sorted(grams[s]), names[s].tobytes(), _pack(sizes[s])) for b, s in _by_bucket(grams, 64, buckets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]],
                ["bucket", "grams", "names", "sizes"],
            )

    def meet(pdf):
        import pandas as pd

        grams = np.concatenate([_unpack_sorted(d) for d in pdf["grams"]])
        names = np.concatenate([np.frombuffer(d, dtype=np.uint64) for d in pdf["names"]])
        sizes = np.concatenate([_unpack(d) for d in pdf["sizes"]]).astype(np.int64)
        order = np.lexsort((names, sizes >> 1, grams))
        grams, names, sizes, inner = grams[order], names[order], sizes[order] >> 1, sizes[order] & 1 == 1
        # in a list sorted by size, each set is led by the last one before it that has the n-gram among its inner ones
        lead = np.maximum.accumulate(np.where(inner, np.arange(len(grams)), -1))
        lead = np.concatenate([[-1], lead[:-1]])
        fits = (lead >= 0) & (grams[lead] == grams) & (100 * sizes[lead] >= percent * sizes) & (names[lead] != names)
        ends = np.unique(np.column_stack([names[lead[fits]], names[fits]]), axis=0)
        nodes, at = np.unique(ends, return_inverse=True)
        root = roots_of(len(nodes), at.reshape(-1, 2))
        moved = root != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[moved].view(np.int64), "v": nodes[root[moved]].view(np.int64)})

    return texts.mapInArrow(send, "bucket int, grams binary, names binary, sizes binary").groupBy("bucket").applyInPandas(meet, "u long, v long")


def divide_skip(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever of these sets is connected by links: a spanning forest.

    A set is searched unless all sets that are still to be searched are known to be connected.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    grams, at = np.unique(flat, return_inverse=True)
    own = np.repeat(np.arange(m), sizes)
    order = np.argsort(at, kind="stable")
    members = own[order]  # the inverted lists one after the other, members ascending
    lengths = np.bincount(at, minlength=len(grams))
    starts = np.cumsum(lengths) - lengths
    ends_of_sets = np.cumsum(sizes)
    root = list(range(m))
    # per root the sets still to be searched; the heap has a valid entry for each root that has any
    todo = [[i] for i in range(m)]
    heap = [(1, i) for i in range(m)]
    open_roots = m
    links = []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while open_roots > 1:
        count, r = heapq.heappop(heap)
        if root[r] != r or len(todo[r]) != count:
            continue
        q = todo[r].pop()
        if todo[r]:
            heapq.heappush(heap, (count - 1, r))
        else:
            open_roots -= 1
        need = (percent * sizes[q] + 99) // 100
        mine = at[ends_of_sets[q] - sizes[q] : ends_of_sets[q]]
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        # the longest lists are probed, not merged; how many pays grows with T and falls with the longest list
        n_long = min(int(need / (0.1 * np.log2(lengths[mine[-1]] + 1) + 1)), int(need) - 1, len(mine) - 1)
        n_long = min(n_long, int((lengths[mine] > 16).sum()))
        short, long_ = mine[: len(mine) - n_long], mine[len(mine) - n_long :]
        n = lengths[short]
        ends = np.cumsum(n)
        merged = members[np.repeat(starts[short] - (ends - n), n) + np.arange(ends[-1])]
        # only members of the merged lists are counted
        found, both = np.unique(merged, return_counts=True)
        fits = (both >= need - n_long) & (100 * np.minimum(sizes[found], sizes[q]) >= percent * np.maximum(sizes[found], sizes[q])) & (found != q)
        found, both = found[fits], both[fits]
        for g in long_.tolist() if len(found) else ():
            inverted = members[starts[g] : starts[g] + lengths[g]]
            place = np.minimum(np.searchsorted(inverted, found), len(inverted) - 1)
            both = both + (inverted[place] == found)
        for other in found[100 * both >= percent * (sizes[found] + sizes[q] - both)].tolist():
            a, b = find(q), find(other)
            if a == b:
                continue
            links.append((q, other))
            if len(todo[a]) < len(todo[b]):
                a, b = b, a
            open_roots -= bool(todo[b])
            root[b] = a
            todo[a] += todo[b]
            todo[b] = []
            if todo[a]:
                heapq.heappush(heap, (len(todo[a]), a))
    return links


def _tasks(rows: DataFrame, parts: DataFrame, percent: int, block: int, buckets: int) -> DataFrame:
    """(node, task, group): where each candidate set is searched. Only numbers move here, no sets.

    A group is a connected part, or a pair of blocks of one that has more than ``block`` n-grams; small groups share tasks.
    """
    sets = stored(rows.select("node", "size").dropDuplicates(["node"]).join(parts, "node"), "candidates")
    by_size = sets.groupBy("root", "size").agg(F.sum("size").alias("grams"))
    before = W.partitionBy("root").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    cut = by_size.withColumn("block", F.floor(F.coalesce(F.sum("grams").over(before), F.lit(0)) / F.lit(block)))
    ranges = cut.groupBy("root", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("grams").alias("grams"))
    ranges = ranges.withColumn("parts", F.ceil(F.col("grams") / F.lit(block)).cast("int"))
    blocks = stored(ranges.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lo", "hi", "parts"), "blocks")
    x = blocks.select("root", F.struct("lo", "hi", "part", "parts").alias("a"))
    y = blocks.select("root", F.struct("lo", "hi", "part", "parts").alias("b"))
    pairs = x.join(y, "root").filter((F.col("a") <= F.col("b")) & (100 * F.col("a.hi") >= percent * F.col("b.lo")))
    pairs = pairs.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("root")))
    task = F.when(F.col("n") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.xxhash64("root", "a", "b").bitwiseOR(F.lit(1 << 62)))
    sides = pairs.select("root", "a", "b", task.alias("task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("s"))
    sides = stored(sides.select("root", "task", F.xxhash64("root", "a", "b").alias("group"), "s"), "sides")
    fits = (F.col("size") >= F.col("s.lo")) & (F.col("size") <= F.col("s.hi")) & (F.pmod(F.xxhash64("node"), F.col("s.parts")) == F.col("s.part"))
    return sets.join(sides, "root").filter(fits).select("node", "task", "group")


def links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows (id, h, node, size), one per document, h its text hash as in ``keyed``; roots (node, root), the connected sets. Sets that link with
    no other are in no row of roots."""
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def names(batches):
        for part in chunks(batches, most=_SLICE):
            _, at, found = _grams(part, n)
            empty = np.diff(at) == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), pa.array(found.view(np.int64), mask=empty), pa.array(np.diff(at))], ["id", "h", "node", "size"]
            )

    rows = stored(texts.mapInArrow(names, f"id {kind}, h long, node long, size long"), "rows")
    # a bucket of n-grams is met in one task: its size is fixed, their number follows the input
    grams = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(math.ceil(grams / BUCKET), min(4 * partitions, max(partitions, grams >> 20)))
    texts = texts.select("text")
    maps = spark.sparkContext.broadcast(level_maps(texts, n, grams, buckets))
    parts = stored(components(candidates(texts, n, percent, maps, buckets)), "parts")
    tasks = stored(_tasks(rows, parts, percent, BLOCK, buckets), "tasks")
    wanted = spark.sparkContext.broadcast(bit_map(parts, "node", most_bits=NODE_BITS))

    def send(batches):
        for part in chunks(batches, most=_SLICE):
            found = [(_signed(x), _pack_sorted(g)) for x, g in _sets(part, n, wanted.value)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([g for _, g in found], pa.binary())], ["node", "grams"])

    # a set comes once from each slice that has it; a task keeps one of them
    dealt = texts.mapInArrow(send, "node long, grams binary").join(tasks, "node").select("task", "group", "node", "grams")

    def search(pdf):
        import pandas as pd

        out = []
        for _, group in pdf.drop_duplicates(["group", "node"]).groupby("group"):
            nodes = group["node"].to_numpy()
            if len(nodes) > 1:
                out += [(int(nodes[a]), int(nodes[b])) for a, b in divide_skip([_unpack_sorted(d) for d in group["grams"]], percent)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows, components(dealt.groupBy("task").applyInPandas(search, "u long, v long"))


def join_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id): the smallest id that a document reaches by links."""
    rows, roots = links(docs, n, percent, id_col, text_col)
    linked = rows.join(roots, "node", "left").select("id", "size", F.coalesce("root", "node").alias("root"))
    least = stored(linked.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component")), "least")
    return linked.join(least, "root", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def first_rows(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h): the key of one row per component, the one with the smallest id and then text hash; null ids come last.

    Texts without words link with nothing, so each distinct row of them stands for itself.
    """
    rows, roots = links(docs, n, percent, id_col, text_col)
    linked = rows.join(roots, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))
    least = linked.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("m"))
    return least.select("m.id", "m.h").unionByName(linked.filter(F.col("root").isNull()).select("id", "h").distinct())


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
