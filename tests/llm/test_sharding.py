"""Shards are near equal in size and numbered without gaps, also under ties and hot values."""

import zlib

import pytest

from tollmill.llm.sharding import kd_shards, op3_sharding, points


def shards(df, **k):
    return kd_shards(df, ["n_chars", "lang"], **k).collect()


@pytest.mark.parametrize("texts", [["x" * (i % 50 + 1) for i in range(900)], ["same text"] * 900, ["a" * (1 if i % 3 else 300) for i in range(900)]])
def test_balance(documents, texts):
    rows = shards(documents(texts), shards=7)
    size = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(7)}
    assert len(rows) == 900 and max(size.values()) - min(size.values()) <= 4 * max(r["size"] for r in rows)
    for s in range(7):
        mine = sorted((r["slot"], r["id"]) for r in rows if r["shard"] == s)
        assert [slot for slot, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
    assert all(r["crc"] == zlib.crc32(texts[r["id"]].encode()) and r["size"] == len(texts[r["id"]]) + 8 for r in rows)


def test_target_bytes(documents):
    rows = shards(documents(["x" * 92] * 100), target_bytes=1000)
    assert {r["shard"] for r in rows} == set(range(10))


def test_few_rows_nulls_repeats_and_extra_columns(clashing):
    rows = shards(clashing, shards=24)
    assert len(rows) == clashing.count() and all(0 <= r["shard"] < 24 for r in rows)
    assert len({r["shard"] for r in rows if r["id"] == 0}) == 1
    assert shards(clashing.limit(0), shards=24) == []


def brute(rows, shards):
    """Recursive halving of (crc, size, c, th, ih) rows by the same cells, one dimension."""
    if shards == 1 or not rows:
        return [rows] + [[]] * (shards - 1)
    left = shards // 2
    want = sum(r["size"] for r in rows) * left / shards
    picked, cut = rows, []
    for key in ("c0", "th", "ih"):
        below, sizes = 0, {}
        for r in picked:
            sizes[r[key]] = sizes.get(r[key], 0) + r["size"]
        for at in sorted(sizes):
            if below + sizes[at] >= want:
                break
            below += sizes[at]
        want -= below
        if key == "ih" and want * 2 < sizes[at]:
            at -= 1
        cut.append(at)
        picked = [r for r in picked if r[key] == at]
    low = [r for r in rows if [r["c0"], r["th"], r["ih"]] <= cut]
    high = [r for r in rows if [r["c0"], r["th"], r["ih"]] > cut]
    return brute(low, left) + brute(high, shards - left)


@pytest.mark.parametrize("count", [2, 7, 24])
def test_shards_equal_brute_force(documents, count):
    docs = documents(["word " * (i * i % 37) + "x" * (i % 5) for i in range(700)])
    rows, total = points(docs, ["n_chars"], "doc_id", "text")
    rows = [r.asDict() for r in rows.collect()]
    assert total == sum(r["size"] for r in rows)
    want = {r["id"]: s for s, mine in enumerate(brute(rows, count)) for r in mine}
    assert {r["id"]: r["shard"] for r in kd_shards(docs, ["n_chars"], shards=count).collect()} == want


def test_query_keeps_its_contract(spark):
    import duckdb

    from tests.conftest import DATA

    got = op3_sharding(spark, DATA).toPandas()  # noqa: F841
    docs = f"read_parquet('{DATA}/documents.parquet')"
    left = duckdb.sql(f"select count(*) from got g full join {docs} d using (doc_id) where g.doc_id is null or d.doc_id is null or size <> octet_length(encode(coalesce(text, ''))) + 8").fetchall()[0]
    slots = duckdb.sql("select count(*) from (select slot, row_number() over (partition by shard order by doc_id) - 1 as want from got) where slot <> want").fetchall()[0]
    shards, small, large = duckdb.sql("select count(*), min(s), max(s) from (select sum(size) as s from got group by shard)").fetchall()[0]
    near = 4 * got["size"].max()  # as in test_balance
    assert left == (0,) and slots == (0,) and shards == 24 and large - small <= near
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and got["shard"].between(0, 23).all()
