"""Encoding against the library, and decoding as its inverse."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tollmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "A<|endoftext|>B <|EndOfText|>", "x y z \u0085q\x1cw", "İstanbul ΟΔΟΣ ΣΑΣ é ̈a", "", "  ", "don't I'LL we're ''s !'s",
    "日本語テキスト１２３ ½ ²", "Ångström ﬁ", None, "<|startoftext|>", "word " * 3000, "x" * 5000,
]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], dtype="<u4").tolist(), r["decoded"]) for r in df.collect()), key=repr)


def expected(i, text):
    t = bpe.tokenizer(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return i, len(ids), ids, t.decode(ids, skip_special_tokens=False)


def test_like_the_library(documents):
    assert rows_of(bpe.encode_decode(documents(ODD), PATH)) == sorted((expected(i, t) for i, t in enumerate(ODD)), key=repr)


def test_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20)
    assert rows_of(bpe.encode_decode(documents(ODD), PATH)) == sorted((expected(i, t) for i, t in enumerate(ODD)), key=repr)


def test_nulls_repeats_and_extra_columns(clashing):
    got = rows_of(bpe.encode_decode(clashing, PATH))
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in clashing.select("doc_id", "text").collect()), key=repr)


def test_empty_table(clashing):
    assert bpe.encode_decode(clashing.limit(0), PATH).count() == 0


def test_decode_joins_pieces(spark):
    t = bpe.tokenizer(PATH)
    ids = t.encode("Hello, hello world <|endoftext|>", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH).collect()}
    assert got == {1: t.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_cut_at_white_space_encode_like_the_whole(text):
    t = bpe.tokenizer(PATH)
    whole = t.encode(text, add_special_tokens=False).ids
    parts = [i for w in bpe.split_words(text) for i in t.encode(w.decode(), add_special_tokens=False).ids]
    assert parts == whole


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_packing(n):
    numbers = (np.arange(n, dtype=np.uint64) * 7_654_321 % 2**32).astype(np.uint32)
    assert bpe._unpack(bpe._pack(numbers)).tolist() == numbers.tolist()


def test_query_digests(spark):
    rows = bpe.op2_bpe(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id").isin([r["doc_id"] for r in rows])).collect()}
    for r in rows:
        _, n, ids, text = expected(r["doc_id"], texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            n, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
