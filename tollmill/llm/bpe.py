"""Operator 2: BPE encoding and decoding over a table of distinct words.

Texts are cut at ASCII white space. No token of the vocabulary spans white space, and normalisation does not look across
it, so the ids of a text are the ids of its words in order, and each distinct word is encoded once:

1. a block of documents (about ``BLOCK_BYTES`` of text) becomes a list of its distinct words and, per text, the array of
   their numbers in that list;
2. the word lists of all blocks are dealt out by the hash of the word and met in one table of distinct words, where each
   word is encoded; a word goes there once from a block, however often it occurs, so frequent words are no hot keys;
3. the ids go back to the blocks and take the places of the word numbers; texts never move, only arrays of numbers.

Decoding joins each id with its piece. The vocabulary has a fixed size, so its side is at hand in every task.

Null texts count as empty: no ids, empty decoded text. An empty table gives an empty result. Rows that repeat an id and
its text get equal results; a null id stays null. Further columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollmill.llm.common import chunks, keyed, table

BLOCK_BYTES = 16 << 20
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, read once per worker."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def pieces_of(path: str) -> np.ndarray:
    """Pieces by id."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = np.full(max(vocab.values()) + 1, "", dtype=object)
    pieces[list(vocab.values())] = list(vocab.keys())
    return pieces


def split_words(text: str) -> list[bytes]:
    """Words of a text as UTF-8. The vocabulary folds case; folding ASCII early saves distinct words.

    Special tokens are told by their case, so texts that could hold one are left as they are.
    """
    return (text.lower() if text.isascii() and "<|" not in text else text).encode().split()


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


_DOCS = "array<struct<id:{0}, codes:binary>>"
_WORDS = "array<struct<bucket:int, words:binary>>"


def number_words(texts: DataFrame, buckets: int) -> DataFrame:
    """(block, docs, bucket_of, dictionary): texts as word numbers, and the words of each block by bucket.

    Numbers follow the frequency in the block. The same rows give the same blocks and numbers each time.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def number(batches):
        import zstandard
        from xxhash import xxh64_intdigest

        for block in chunks(batches, most=BLOCK_BYTES):
            numbers: dict[bytes, int] = {}
            coded = []
            for text in block.column("text").to_pylist():
                words = split_words(text)
                coded.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint32, count=len(words)))
            words = np.empty(len(numbers), dtype=object)
            words[:] = list(numbers)
            numbers.clear()
            together = np.concatenate(coded)
            by_count = np.argsort(-np.bincount(together, minlength=len(words)), kind="stable")
            renumber = np.empty(len(words), dtype=np.uint32)
            renumber[by_count] = np.arange(len(words), dtype=np.uint32)
            words = words[by_count]
            bucket_of = np.fromiter((xxh64_intdigest(w) % buckets for w in words), dtype=np.uint32, count=len(words))
            order = np.argsort(bucket_of, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket_of[order])) + 1
            dictionary = [
                {"bucket": int(bucket_of[part[0]]), "words": zstandard.ZstdCompressor(level=3).compress(b"\n".join(words[part]))}
                for part in np.split(order, cuts) if len(part)
            ]
            keys = np.asarray(block.column("h")).tobytes() + repr(block.column("id").to_pylist()).encode()
            docs = [{"id": i, "codes": _pack(renumber[c])} for i, c in zip(block.column("id").to_pylist(), coded)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.uint64(xxh64_intdigest(keys)).astype(np.int64)]),
                 pa.array([docs], pa.list_(pa.struct([("id", block.schema.field("id").type), ("codes", pa.binary())]))),
                 pa.array([_pack(bucket_of)], pa.binary()),
                 pa.array([dictionary], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))],
                ["block", "docs", "bucket_of", "dictionary"],
            )

    return texts.mapInArrow(number, f"block long, docs {_DOCS.format(id_type)}, bucket_of binary, dictionary {_WORDS}")


def encode_words(dictionaries: DataFrame, path: str) -> DataFrame:
    """(block, bucket, counts, ids) from (block, bucket, words): the ids of each list of words, each distinct word encoded once."""

    def encode(pdf):
        import pandas as pd
        import zstandard

        lists = [zstandard.ZstdDecompressor().decompress(w).split(b"\n") for w in pdf["words"]]
        distinct = sorted(set().union(*lists))
        at = {w: i for i, w in enumerate(distinct)}
        ids: list[np.ndarray] = []
        for i in range(0, len(distinct), 20_000):
            batch = tokenizer(path).encode_batch([w.decode() for w in distinct[i : i + 20_000]], add_special_tokens=False)
            ids += [np.array(e.ids, dtype=np.uint32) for e in batch]
        out = []
        for words in lists:
            own = [ids[at[w]] for w in words]
            out.append((_pack(np.array([len(x) for x in own], dtype=np.uint32)), _pack(np.concatenate(own))))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [a for a, _ in out], "ids": [b for _, b in out]})

    return dictionaries.groupBy("bucket").applyInPandas(encode, "block long, bucket int, counts binary, ids binary")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) of every text: ids as little-endian unsigned 32-bit numbers, decoded as a string."""
    texts = keyed(docs, id_col, text_col)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = number_words(texts, buckets)
    words = numbered.select("block", F.explode("dictionary").alias("d")).select("block", "d.bucket", "d.words")
    back = encode_words(words, path).groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "ids")).alias("ids"))
    # a block may occur twice if its rows do: its ids are the same then
    joined = numbered.select("block", "docs", "bucket_of").join(back, "block", "left")
    id_type = texts.schema["id"].dataType.simpleString()

    def assemble(batches):
        pieces = pieces_of(path)
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].as_py()
                bucket_of = _unpack(batch.column("bucket_of")[row].as_py())
                lists = {x["bucket"]: x for x in batch.column("ids")[row].as_py() or ()}
                counts = np.zeros(len(bucket_of), dtype=np.int64)
                order = np.argsort(bucket_of, kind="stable")
                flat = [np.zeros(0, dtype=np.uint32)]
                for part in np.split(order, np.flatnonzero(np.diff(bucket_of[order])) + 1):
                    if len(part):
                        found = lists[int(bucket_of[part[0]])]
                        counts[part] = _unpack(found["counts"])
                        flat.append(_unpack(found["ids"]))
                flat = np.concatenate(flat)
                starts = np.zeros(len(bucket_of), dtype=np.int64)
                starts[order] = np.cumsum(counts[order]) - counts[order]
                for i in range(0, len(docs), 256):
                    part = docs[i : i + 256]
                    encoded = []
                    for d in part:
                        codes = _unpack(d["codes"])
                        n = counts[codes]
                        ends = np.cumsum(n)
                        encoded.append(flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d["id"] for d in part], batch.schema.field("docs").type.value_type.field("id").type),
                         pa.array([len(x) for x in encoded], pa.int64()),
                         pa.array([x.astype("<u4").tobytes() for x in encoded], pa.binary()),
                         pa.array([" ".join(pieces[x]) for x in encoded], pa.string())],
                        [id_col, "n_tokens", "ids", "decoded"],
                    )

    return joined.mapInArrow(assemble, f"`{id_col}` {id_type}, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): texts of arrays of ids, by a join of each id with its piece.

    Null arrays decode as empty. The vocabulary has a fixed size, so its side is broadcast. Ids must be unique.
    """
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = encoded.sparkSession.createDataFrame([(i, p) for p, i in vocab.items()], "token int, piece string")
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    by_place = rows.select("id", F.posexplode_outer("ids").alias("pos", "token")).join(F.broadcast(pieces), "token", "left")
    placed = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return by_place.groupBy("id").agg(placed.alias("p")).select(
        F.col("id").alias(id_col), F.array_join(F.col("p.piece"), " ").alias("decoded")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
