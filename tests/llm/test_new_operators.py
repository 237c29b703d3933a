"""Operators 11 to 13 against plain versions: SQL over the test tables, loops over rows with nulls, ties and repeats."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA, values
from tollmill.llm import filter_audit, negatives, packing
from tollmill.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bits int, h long, part string, words int"
LABELS = "doc_id long, quality int, toxic int, n int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    got = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert values(got, *names) == sorted(cursor.fetchall(), key=repr)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 1, 2, "x", 3) for i, t, s in rows], DOCS)


def _audit_by_hand(docs, labels):
    texts = [(i, t or "", s or "") for i, t, s in docs]
    rows = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": any(j is not None and i is not None and j < i and u == t for j, u, _ in texts)}
        good = any(d == i and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if d is not None)
        rows.append((s, {f for f in bad if bad[f]}, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(hit)
                unique = sum(r[1] == {f} for r in own)
                out.append([part, "".join(order), step, len(left), len(hit), redundant, unique, sum(r[2] for r in hit), sum(r[3] for r in hit)])
                removed_by[f] = removed_by.get(f, 0) + len(hit)
        for r in out:
            if r[0] == part:
                r.append(removed_by[r[1][r[2] - 1]])
    return sorted(map(tuple, out), key=repr)


def test_filter_audit_with_nulls_repeats_and_long_texts(spark):
    fine = " ".join(f"word{i}" for i in range(60))
    rows = [
        (5, fine, "a"), (3, fine, "b"), (9, fine, "a"), (9, fine, "a"), (None, fine, "a"), (3, fine, "b"), (1, None, None), (2, "", ""),
        (4, fine + " #", "a"), (6, fine.upper(), "a"), (7, "same " * 100_000, "c"), (8, "same " * 100_000, "c"), (10, " \t\n\x0b\x0c\r", "c"),
        (11, "É" * 30 + "Ab c", "d"), (None, None, None), (12, "  " + fine + "\n", "a"),
    ]
    labels = [(5, 1, 0), (3, 0, 1), (3, 1, 0), (9, 1, 1), (None, 1, 1), (4, None, 1), (77, 1, 1)]
    counted = filter_audit.combinations(_docs(spark, rows), spark.createDataFrame([(*x, 1) for x in labels], LABELS))
    got = filter_audit.audit(counted)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert values(got, *names) == _audit_by_hand(rows, labels)


def test_copies_of_texts_that_share_a_hash(spark):
    rows = [(1, 7, "x"), (2, 7, "y"), (3, 7, "x"), (4, 7, "y"), (5, 8, "z"), (6, 8, "z"), (6, 8, "z"), (0, 9, "x")]
    texts = spark.createDataFrame([(*r, 0) for r in rows], "id long, h long, text string, bits int")
    assert values(filter_audit.later_copies(texts, texts.drop("text")), "id") == [(3,), (4,), (6,), (6,)]


def test_filter_audit_of_nothing(spark):
    counted = filter_audit.combinations(_docs(spark, []), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(counted).count() == 0


def _check_packing(rows, ids_of):
    """``rows``: (doc, start, length, crc, tokens, sequence, offset); every id once, sequences without gaps."""
    sequences = {}
    by_doc = {}
    for doc, start, length, crc, tokens, sequence, offset in rows:
        assert length > 0
        by_doc.setdefault(doc, []).append((start, length, crc, tokens))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        wanted = sorted((s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for ids in ids_of[doc] for s, n, _, t in set(pieces) if t == len(ids) and s < t)
        assert sorted(pieces) == wanted
        assert sum(n for _, n, _, _ in pieces) == sum(len(ids) for ids in ids_of[doc])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def _by_hand(texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.no_truncation()
    plain.no_padding()
    out = {}
    for doc, text in texts:
        out.setdefault(doc, []).append(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    return out


def test_packing_of_the_table(spark):
    got = QUERIES["op12_packing"](spark, DATA)
    assert [f"{n}:{t}" for n, t in got.dtypes] == [
        "doc_id:bigint", "start:bigint", "length:bigint", "ids_crc32:bigint", "doc_tokens:bigint", "sequence_id:bigint", "offset:bigint"
    ]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = [tuple(r) for r in got.collect()]
    assert _check_packing(rows, _by_hand(texts)) < 0.02 * sum(r[2] for r in rows)


def test_packing_with_nulls_repeats_and_long_texts(spark):
    texts = [(1, None), (2, ""), (3, "one text"), (3, "one text"), (4, "<|endoftext|> and <|endoftext|>"), (None, "no id"), (5, "word " * 20_000),
             (6, "é´☃ 中文 ​\U0001F600"), (7, " " * 5_000 + "\n\t x"), (8, "a" * 3_000), (9, "word " * 2_047)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in texts], "doc_id long, text string, length int, piece int, id int")
    path = public_tokenizers.path
    from tollmill.llm.common import stored

    for ranks in (None, path("byte_bpe_50k.tiktoken")):
        parts = packing.pieces(docs, path("byte_bpe_50k.json"), ranks=ranks, pattern=public_tokenizers.PATTERN)
        packed = packing.pack(stored(parts, "pieces"), group=4)
        _check_packing([tuple(r) for r in packed.select("id", "start", "length", "crc", "tokens", "sequence", "offset").collect()], _by_hand(texts))
    assert packing.pack(stored(packing.pieces(docs.limit(0), path("byte_bpe_50k.json")), "none")).count() == 0


def test_first_fit_is_first_fit():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 64, 200):
        sizes = np.sort(draw.integers(1, 60, n))[::-1]
        bins, offsets = packing.first_fit(sizes, 60)
        used: list[int] = []
        for size, at, offset in zip(sizes, bins, offsets):
            fit = next((i for i, u in enumerate(used) if u + size <= 60), len(used))
            used += [0] * (fit == len(used))
            assert (at, offset) == (fit, used[fit])
            used[fit] += size


VECTORS = "vec_id long, embedding array<float>, label int, row int, score int"


def _mine(rows):
    usable = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        usable[(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))] = None
    usable = list(usable)
    order = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for a in usable:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2])), r) for r in usable if r is not a), key=lambda x: order(*x))
        for p, positive in [x for x in scored if x[1][1] == a[1]][:5]:
            hard = [x for x in scored if x[1][1] != a[1] and 80 * p <= 100 * x[0] <= 100 * p][:5]
            out += [(a[0], positive[0], k, r[0], p, s) for k, (s, r) in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["odd", "clustered", "copies"])
def test_hard_negatives_against_loops(spark, kind, monkeypatch):
    draw = np.random.default_rng(11)
    monkeypatch.setattr(negatives, "BLOCK", 150)
    if kind == "odd":
        nan, inf = float("nan"), float("inf")
        rows = [(i, draw.normal(size=int(draw.integers(0, 4))).round(1).tolist(), int(draw.integers(0, 3))) for i in range(0, 600, 5)]
        rows += [(1, None, 1), (2, [None, 1.0], 1), (3, [nan], 1), (4, [inf, 0.0], 1), (6, [1.0], None), (None, [1.0, 1.0, 1.0], 2), (100, [0.5], 0)]
        rows += rows[:40]
    elif kind == "clustered":
        centres = draw.normal(size=(8, 6))
        rows = [(i, (centres[i % 8] + 0.05 * draw.normal(size=6)).tolist(), int(draw.integers(0, 4))) for i in range(700)]
    else:
        rows = [(i, [1.0, -2.0, 0.5] if i % 2 else draw.normal(size=3).tolist(), int(draw.integers(0, 3))) for i in range(500)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)
    got = negatives.hard_negatives(table, lambda i: i % 100 == 0, lambda i, label: (negatives.F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)))
    assert values(got, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == _mine(rows)


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    rows = [(100, [1e12, 3.0], 1), (101, [1e12, 2.0], 1), (102, [1e12, 1.0], 2), (103, [9e11, 1.0], 2), (105, [1.0, 1.0], 2)]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS.replace("float", "double"))
    got = negatives.hard_negatives(table, lambda i: i % 100 == 0)
    assert values(got, "positive_id", "rank", "negative_id") == [(101, 1, 102), (101, 2, 103)]
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty, lambda i: i % 100 == 0).count() == 0


def test_threshold_stops_early_in_clusters():
    """In clustered data many rows of a block are never scored."""
    draw = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(np.eye(16), 500, axis=0) + 0.01 * draw.normal(size=(8000, 16)))).astype(np.int64)
    lists = np.argsort(x, axis=0, kind="stable").T
    import pyarrow as pa

    anchors = negatives.Anchors(pa.table({"id": [0], "label": [1], "row": [-1], "v": [x[0].tolist()]}), 16, 5)

    class Seen(np.ndarray):
        scored = 0

        def __matmul__(self, other):
            Seen.scored += len(self)
            return np.asarray(self) @ np.asarray(other)

    found = negatives.threshold_search(anchors, np.ones(8000, np.int64), np.arange(8000), x.view(Seen), lists, 5, True)
    best = np.argsort(-(x @ x[0]), kind="stable")[:5]
    assert [f[2] for f in found] == best.tolist()
    assert Seen.scored < 6000
