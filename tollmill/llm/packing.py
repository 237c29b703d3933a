"""Operator 12: token sequences of a fixed length, packed by first-fit decreasing in randomised groups of documents.

1. Each document is encoded where it lies, ends with an end id, and is cut into pieces of the sequence length and one shorter
   rest. Where the cuts fall depends on its own length alone, so checksums are taken at once and no ids move.
2. A full piece is a sequence of its own: first-fit decreasing would put it first, into an empty bin. The rests are dealt by
   the hash of their row into groups of about ``GROUP`` pieces, as many groups as their number asks for, so a group has the
   same size whatever the corpus, and no document, source or copied text makes one larger.
3. Each group is packed on its own: from the longest rest on, each goes into the first bin with room for it. A tournament
   tree holds the room of the bins; its root has the largest, and the way down to the first bin with enough takes one step a
   level. Equal lengths follow the number of the piece.

A rest is never cut, so nothing but the last bins of a group has much padding. A sequence is padded to the full length,
unless its length is a power of two.

Null texts count as empty and have the end id alone. Texts are encoded whole at any length. Rows that repeat an id, or an id
and its text, are documents of their own, each with its pieces; null ids stay null. Which sequence holds a piece depends on
the layout of the input, but the packed table is written once and read from there. An empty table gives an empty result.
Further columns of the input are not looked at. Special tokens in a text count as such, as in the library.

The ids are those of the ``tokenizers`` library. Where a file of the same vocabulary as ranks is given (``ranks``), texts are
encoded by ``tiktoken``, which gives the same ids in a quarter of the time (compared around each Unicode character).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.bpe import tokenizer
from tollmill.llm.common import chunks, stored, table

LENGTH, END = 2048, 1
GROUP = 16_384
_RANKS: dict = {}
#: texts with longer runs of white space are left to the other library, whose patterns do not backtrack
_LONG_RUN = regex.compile(r"\s{100000}")


def _by_ranks(path: str, special: dict[str, int], pattern: str):
    """The vocabulary of a file of ranks as a ``tiktoken`` encoding, read once per worker."""
    if path not in _RANKS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _RANKS[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _RANKS[path]


def encoder(path: str, ranks: str | None = None, pattern: str | None = None):
    """A function from texts to arrays of ids."""
    plain = tokenizer(path)
    special = {t.content: i for i, t in plain.get_added_tokens_decoder().items()} if ranks else {}
    fast = _by_ranks(ranks, special, pattern) if ranks else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        left = []
        for i, text in enumerate(texts):
            if fast is None or len(text) >= 100_000 and _LONG_RUN.search(text):
                left.append(i)
            else:
                out[i] = fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        if left:
            for i, e in zip(left, plain.encode_batch_fast([texts[i] for i in left], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4")
        return out

    return encode


def pieces(
    docs: DataFrame, path: str, length: int = LENGTH, end: int = END, ranks: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, length, crc, tokens, piece): the pieces of each document, numbered without gaps inside a partition."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(path, ranks, pattern)
        tail = np.array([end], dtype="<u4")
        for block in chunks(batches):
            encoded = encode(block.column("text").to_pylist())
            tokens = np.array([len(x) + 1 for x in encoded], dtype=np.int64)
            parts = -(-tokens // length)
            doc = np.repeat(np.arange(len(tokens)), parts)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
            sizes = np.minimum(tokens[doc] - starts, length)
            crcs = [zlib.crc32(np.concatenate([x, tail])[a : a + length]) for x, n in zip(encoded, parts) for a in range(0, n * length, length)]
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(pa.array(doc)), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64()), pa.array(tokens[doc])],
                ["id", "start", "length", "crc", "tokens"],
            )

    return texts.mapInArrow(cut, f"id {id_type}, start long, length long, crc long, tokens long").withColumn(
        "piece", F.monotonically_increasing_id()
    )


def first_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given; each goes into the first bin with room for it."""
    leaves = 1 << max(1, len(sizes) - 1).bit_length()
    room = [length] * (2 * leaves)
    used = [0] * len(sizes)
    offsets = [0] * len(sizes)
    for item, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        used[item] = node - leaves
        offsets[item] = length - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return np.array(used, dtype=np.int64), np.array(offsets, dtype=np.int64)


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds (sequence, offset) to a written table of pieces. Sequences have numbers of their own, not without gaps."""
    rests = parts.filter(F.col("length") < length)
    groups = max(1, math.ceil(rests.count() / group))
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    schema = f"id {parts.schema['id'].dataType.simpleString()}, start long, length long, crc long, tokens long, piece long, sequence long, offset long"

    def fill(rows: pa.Table) -> pa.Table:
        number = rows.column("group")[0].as_py()
        rows = rows.select(["id", "start", "length", "crc", "tokens", "piece"]).sort_by([("length", "descending"), ("piece", "ascending")])
        bins, offsets = first_fit(np.asarray(rows.column("length")), length)
        # even numbers, told apart by group
        return rows.append_column("sequence", pa.array(2 * (bins * groups + number))).append_column("offset", pa.array(offsets))

    full = parts.filter(F.col("length") == length).select(
        "id", "start", "length", "crc", "tokens", "piece", (F.col("piece") * 2 + 1).alias("sequence"), F.lit(0).cast("long").alias("offset")
    )
    return dealt.groupBy("group").applyInArrow(fill, schema).unionByName(full)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    parts = pieces(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    packed = pack(stored(parts, "pieces"))
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.col("sequence").alias("sequence_id"), "offset",
    )
