"""Row numbers, percentiles and traces on skewed and awkward data."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tollmill.operators import audit as U
from tollmill.operators import ordering as O
from tollmill.operators import profiling as P
from tollmill.operators import relational as J
from tollmill.sources.splits import split_head


def test_number_rows_with_a_hot_key(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 700)).repartition(7)
    got = {r["id"]: r["_row"] for r in O.number_rows(df, ["k", "id"]).collect()}
    order = sorted(range(5000), key=lambda i: (1 if i % 3 == 0 else i % 700, i))
    assert [got[i] for i in order] == list(range(1, 5001))


def test_number_rows_with_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(1,)] * 400 + [(0,)] * 2, "k int")
    got = values(O.number_rows(df, ["k"]), "_row")
    assert got == sorted([(i,) for i in range(1, 406)], key=repr)
    assert {r["_row"] for r in O.number_rows(df, ["k"]).filter("k is null").collect()} == {1, 2, 3}


def test_running_sum(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 10)
    got = {r["id"]: r["cumulative"] for r in O.running_sum(df, ["id"], "w").collect()}
    assert got[999] == 4500 and got[9] == 45


def test_split_head_sizes(spark):
    for n, ratio, head in ((10, 0.8, 8), (11, 0.5, 5), (1, 0.8, 0)):
        a, b = split_head(spark.range(n), "id", ratio)
        assert (a.count(), b.count()) == (head, n - head)


@pytest.mark.parametrize("data", [
    [1.0], [1.0, 2.0], [5.0] * 100, [5.0] * 90 + [1e9], [float(i) for i in range(1001)],
    [random.Random(3).lognormvariate(0, 4) for _ in range(3000)], [0.1] * 500 + [0.1000001] * 499 + [-1e12],
])
def test_exact_percentiles(spark, data):
    df = spark.createDataFrame([("x", v) for v in data], "field string, value double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["percentile"] for r in P.exact_percentiles(df, probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(data, 100 * p), rel=1e-12, abs=1e-12)


def test_shares_keep_null_groups(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 3), ("x", "a", 5)], "g string, v string, cnt int")
    assert values(O.with_share(df, over="g"), "g", "v", "share") == sorted(
        [(None, "a", 0.25), (None, "b", 0.75), ("x", "a", 1.0)], key=repr
    )


def test_top_fraction(spark):
    df = spark.range(23)
    assert values(O.top_fraction(df, [F.desc("id")], cap=50), "id") == sorted([(i,) for i in (22, 21, 20, 19)], key=repr)
    assert O.top_fraction(spark.range(1000), [F.desc("id")], cap=50).count() == 50
    assert O.top_fraction(spark.range(1000), [F.desc("id")]).count() == 200
    assert O.top_fraction(spark.range(4), [F.desc("id")]).count() == 0


LOG = "id int, trace_id string, parent_trace_id string"


def test_trace_tree_shapes(spark):
    chain = [(i, f"c{i}", f"c{i - 1}" if i else None) for i in range(40)]
    star = [(100, "hub", None)] + [(101 + i, f"leaf{i}", "hub") for i in range(300)]
    loop = [(900, "x", "y"), (901, "y", "x"), (902, "tail", "x")]
    orphan = [(950, "o", "never logged"), (951, "under", "o"), (952, "own", "own")]
    log = spark.createDataFrame(chain + star + loop + orphan, LOG)
    got = {r["id"]: (r["root"], r["depth"]) for r in U.trace_tree(log).collect()}
    assert all(got[i] == ("c0", i) for i in range(40))
    assert all(got[101 + i] == ("hub", 1) for i in range(300))
    assert got[950] == ("o", 0) and got[951] == ("o", 1)
    assert all(got[i] == (None, None) for i in (900, 901, 902))
    assert got[952] == ("own", 0)
    one = U.trace_tree(log, "c5")
    assert {(r["trace_id"], r["depth"]) for r in one.collect()} == {(f"c{i}", i - 5) for i in range(5, 40)}
    assert one.filter("trace_id = 'c7'").head()["path"] == "c5>c6>c7"


def test_trace_with_several_calls_and_parents(spark):
    log = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "a"), (4, "b", "z"), (5, "z", None)], LOG)
    got = values(U.trace_tree(log), "id", "root", "path")
    assert got == sorted(
        [(1, "a", "a"), (2, "a", "a"), (3, "a", "a>b"), (4, "z", "z>b"), (5, "z", "z")], key=repr
    )


def test_resolve_section(spark):
    section = spark.createDataFrame([("S2", "North Road"), ("S1", "Road"), ("S3", "Bay")], "section_id string, section_name string")
    texts = spark.createDataFrame([("take the North Road",), ("Bay to Road",), ("nothing",), (None,), ("B",)], "t string")
    found = J.resolve_section(texts, section, "t")
    want = sorted([("take the North Road", "S1"), ("Bay to Road", "S1"), ("nothing", None), (None, None), ("B", None)], key=repr)
    assert values(found, "t", "resolved_section_id") == want
    many = section.unionByName(spark.range(3000).select(F.concat(F.lit("X"), F.col("id")).alias("section_id"), F.concat(F.lit("Way no "), F.col("id")).alias("section_name")))
    assert values(J.resolve_section(texts, many, "t"), "t", "resolved_section_id") == want
    assert J.resolve_section(texts, section.limit(0), "t").filter("resolved_section_id is not null").count() == 0


def _tree(spark, rows):
    log = spark.createDataFrame(rows, "id int, trace_id string, parent_trace_id string")
    return values(U.trace_tree(log), "id", "root", "path")


def test_trace_tree_resolves_each_call(spark):
    assert _tree(spark, [(1, "p", None), (2, "t", None), (3, "t", "p")]) == sorted([(1, "p", "p"), (2, "t", "t"), (3, "p", "p>t")], key=repr)


def test_trace_tree_ends_on_circles(spark):
    rows = [(1, "a", "b"), (2, "a", "c"), (3, "b", "a"), (4, "c", "a"), (5, "p", None), (6, "q", "p"), (7, "s", "s"), (8, "kid", "s")]
    circles = [(i, None, None) for i in (1, 2, 3, 4)]
    assert _tree(spark, rows) == sorted([*circles, (5, "p", "p"), (6, "p", "p>q"), (7, "s", "s"), (8, "s", "s>kid")], key=repr)


def test_trace_tree_of_a_diamond_and_a_long_chain(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(U, "freeze", lambda df, kept=U.freeze: rounds.append(1) or kept(df))
    levels = [("n0", None)] + [(f"{side}{i}", f"n{i}") for i in range(10) for side in "xy"]
    levels += [(f"n{i + 1}", f"{side}{i}") for i in range(7) for side in "xy"]
    got = _tree(spark, [(i, *x) for i, x in enumerate(levels)])
    assert len(levels) == 35 and len({(i, r) for i, r, _ in got}) == len(got) == 35
    by_id = {i: path for i, _, path in got}
    assert by_id[0] == "n0" and by_id[2] == "n0>y0" and by_id[21] == "n0>x0>n1" and by_id[22] == "n0>y0>n1" and by_id[23] == "n0>x0>n1>x1>n2"
    rounds.clear()
    chain = U.trace_tree(spark.createDataFrame([(i, f"c{i}", f"c{i - 1}" if i else None) for i in range(1000)], LOG), with_path=False)
    assert values(chain, "id", "root", "depth") == sorted([(i, "c0", i) for i in range(1000)], key=repr)
    assert len(rounds) <= 1 + 2 * 12


def test_trace_tree_keeps_calls_below_a_shared_id(spark):
    rows = [(1, "p", None), (2, "q", None), (3, "t", "p"), (4, "t", "q"), (5, "x", "t"), (6, "y", "t")]
    got = _tree(spark, rows)
    assert {i for i, _, _ in got} == {1, 2, 3, 4, 5, 6} and len(got) == 8


def test_trace_ways_lists_every_way(spark):
    """Two ways of one length to a call, a longer one, a circle below a root, one beside it, and an own parent."""
    rows = [(1, "p", None), (2, "x", "p"), (3, "y", "p"), (4, "t", "x"), (5, "t", "y"), (6, "end", "t"), (7, "end", "p"), (8, "p", "x")]
    rows += [(20, "a", "b"), (21, "b", "a"), (30, "own", "own"), (31, "own", "lost"), (32, None, "p")]
    got = values(U.trace_ways(spark.createDataFrame(rows, LOG)), "id", "root", "depth", "path")
    again = ["p>x", "p>y", "p>x>t", "p>y>t", "p>x>t>end", "p>y>t>end", "p>end"]
    assert (6, "p", 3, "p>x>t>end") in got and (6, "p", 3, "p>y>t>end") in got and (7, "p", 1, "p>end") in got
    assert {p for _, r, _, p in got if r == "p"} >= set(again) | {"p", "p>x>p", "p>x>p>y>t>end"}
    assert [r for r in got if r[0] == 8] == [(8, "p", 2, "p>x>p")]
    assert [r[1:] for r in got if r[0] in (20, 21)] == [(None, None, None)] * 2
    assert [r[1:] for r in got if r[0] in (30, 31)] == [("own", 0, "own")] * 2 and not [r for r in got if r[0] == 32]
    kept = values(U.trace_tree(spark.createDataFrame(rows, LOG)), "id", "root", "depth")
    assert {r[:2] for r in kept} == {r[:2] for r in got} and len(got) > len(kept)


def test_match_tags_default(spark):
    queries = spark.createDataFrame([("查询超载情况",), ("hello",)], "query string")
    got = values(J.match_tags(queries), "query", "tag")
    assert ("查询超载情况", "overweight-rate") in got
    assert [t for q, t in got if q == "hello"] == ["avg-travel-time", "congestion-index", "hourly-flow"]


def test_resolve_section_among_names_with_one_beginning(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "freeze", lambda df, kept=J.freeze: seen.append(kept(df)) or seen[-1])
    ids = spark.range(4000)
    names = ids.select(F.concat(F.lit("S"), F.lpad("id", 5, "0")).alias("section_id"), F.concat(F.lit("Great Northern Ring Road no "), F.col("id")).alias("section_name"))
    texts = [f"from Great Northern Ring Road no {i} to the coast" for i in range(0, 4000, 80)] + ["Great Northern Ring Road", "no road"]
    got = dict(values(J.resolve_section(spark.createDataFrame([(t,) for t in texts], "t string"), names, "t"), "t", "resolved_section_id"))
    for i, t in zip(range(0, 4000, 80), texts):
        # names that a longer number begins with occur in it too
        assert got[t] == min(f"S{int(str(i)[:k]):05d}" for k in range(1, len(str(i)) + 1))
    assert got["no road"] is None and got["Great Northern Ring Road"] is None
    places = sum(map(len, texts))
    assert sum(f.count() for f in seen[1:]) < places and seen[-1].select(F.max(F.size("_lengths"))).head()[0] <= 4


@pytest.mark.parametrize("ratio", [0.0005, 0.25, 0.5, 0.8, 1.0])
def test_rank_cut_counts_instead_of_sorting(spark, ratio):
    """A third of the rows share one key, some keys are NULL; few keys are drawn, so there are several rounds."""
    draw = random.Random(5)
    rows = [(None if i % 50 == 0 else 500 if i % 3 == 0 else draw.randrange(1000), draw.choice("abc")) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, s string").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[int(4000 * ratio) - 1]
    got = spark.range(1).select(O.rank_cut(df, ["k", "s"], ratio, drawn=100).alias("c")).first()["c"]
    assert tuple(got) == want


def test_rank_cut_of_nothing(spark):
    assert spark.range(1).select(O.rank_cut(spark.range(0), ["id"], 0.8).alias("c")).first()["c"] is None
    assert spark.range(1).select(O.rank_cut(spark.range(1), ["id"], 0.8).alias("c")).first()["c"] is None


def test_rank_cut_of_a_wide_key(spark):
    """A key of sixteen columns that are worked out: the plan's inferred conditions must not double with each of them."""
    df = spark.range(3000).select(*[((F.col("id") * 7919) % 3001 + i).alias(f"c{i}") for i in range(16)])
    names = df.columns
    want = sorted(tuple((x * 7919) % 3001 + i for i in range(16)) for x in range(3000))[1499]
    begun = time.monotonic()
    assert tuple(spark.range(1).select(O.rank_cut(df, names, 0.5, drawn=1000).alias("c")).first()["c"]) == want
    assert time.monotonic() - begun < 100
