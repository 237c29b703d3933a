"""Exact samples under skew, resampling and correlated draws."""

import random

from pyspark.sql import functions as F

from tests.conftest import values
from tollmill.functions import constants as K
from tollmill.functions.vehicles import freight_class
from tollmill.operators import fidelity as E
from tollmill.operators import learn as M
from tollmill.operators import sampling as G
from tollmill.operators.profiling import fee_mileage_stats, joint_report
from tollmill.sources.readers import sample_n

# vehicle type, axle count, rows: the recorded joint frequencies (fixed values)
JOINT = [
    ("0", "2.0", 3917), ("1", "2.0", 16506), ("1", "255.0", 13861), ("2", "2.0", 79), ("2", "255.0", 48), ("3", "2.0", 76),
    ("3", "255.0", 2), ("4", "2.0", 105), ("11", "2.0", 6941), ("11", "144.0", 1), ("11", "3.0", 1), ("12", "2.0", 188),
    ("12", "5.0", 4), ("12", "4.0", 1), ("13", "6.0", 752), ("13", "3.0", 136), ("13", "5.0", 36), ("13", "2.0", 9),
    ("14", "4.0", 164), ("16", "6.0", 214), ("16", "5.0", 6), ("21", "2.0", 34), ("22", "2.0", 66), ("23", "3.0", 17), ("24", "4.0", 5),
]


def joint(spark):
    df = spark.createDataFrame(JOINT, "vehicle_type string, axle_count string, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("vehicle_type", "axle_count")


def test_joint_report(spark):
    lines = [r[0] for r in joint_report(joint(spark), "vehicle_type", "axle_count").collect()]
    assert lines[:2] == ["total_records: 43169", "vehicle_type,axle_count,count"]
    head = [f"{a},{b},{n}" for a, b, n in JOINT]
    ties = {"11,144.0,1", "11,3.0,1"}  # equal counts may stand in either order
    assert [x for x in lines[2:] if x not in ties] == [x for x in head if x not in ties]


def test_sample_of_copies_is_exact(spark):
    copies = spark.range(30_000).select(F.lit("same").alias("k"))
    mixed = copies.unionByName(spark.range(15_000).select(F.concat(F.lit("k"), F.col("id")).alias("k")))
    picked = G.smallest_by_hash(mixed, [], F.lit(7000), seed=3)
    assert picked.count() == 7000
    top = G.smallest_by_hash(mixed, [], F.lit(44_999), seed=3)
    assert top.count() == 44_999
    assert G.smallest_by_hash(mixed, [], F.lit(100_000), seed=3).count() == 45_000
    assert G.smallest_by_hash(mixed, [], F.lit(0), seed=3).count() == 0


def test_sample_matches_the_plain_ranking(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)))
    keyed = sorted((r["s"], r["k"], r["id"]) for r in df.withColumn("k", G.row_key(["id", "s"], 9)).collect())
    want, seen = set(), {}
    for s, _, i in keyed:
        seen[s] = seen.get(s, 0) + 1
        if seen[s] <= 100:
            want.add(i)
    assert {r["id"] for r in G.smallest_by_hash(df, ["s"], F.lit(100), seed=9).collect()} == want


def test_sample_n(spark):
    df = spark.range(1000)
    a = values(sample_n(df.repartition(3), 50, 1))
    assert len(a) == 50 and a == values(sample_n(df.repartition(9), 50, 1)) and a != values(sample_n(df, 50, 2))
    assert sample_n(df, -1, 1).count() == 1000


def test_rebalance_takes_small_strata_whole(spark):
    df = spark.createDataFrame([(i, "12" if i < 5 else "1") for i in range(500)], "id int, vehicle_type string")
    got = G.rebalance(df, K.CLASS_TARGET, 100, freight_class(F.col("vehicle_type"))).groupBy("vehicle_type").count()
    assert values(got) == [("1", 40), ("12", 5)]


def test_resample_follows_the_source(spark):
    source = joint(spark)
    drawn = G.resample(source, 40_000, cols=("vehicle_type",), seed=1)
    assert drawn.count() == 40_000
    near = {r["field"]: r["similarity"] for r in E.kl_js_smoothed(drawn, source, ["vehicle_type", "axle_count"]).collect()}
    assert min(near.values()) > 0.999
    known = {(a, b) for a, b, _ in JOINT}
    assert {tuple(r) for r in drawn.select("vehicle_type", "axle_count").distinct().collect()} <= known


def verifier_rows(spark, n=400):
    """Half cars at 0.09 a metre without weight, half trucks at 0.18 with 10-25 t; 5-30 km."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        metres = rng.randint(5000, 30000)
        car = i % 2 == 0
        fee = int(metres * (0.09 if car else 0.18) * rng.uniform(0.95, 1.05))
        weight = "0" if car else str(rng.randint(10000, 25000))
        rows.append(("1" if car else "12", fee, str(metres), weight, "2"))
    return spark.createDataFrame(rows, "vehicle_type string, pay_fee int, fee_mileage string, total_weight string, axle_count string")


def test_conditional_normal(spark):
    stats = fee_mileage_stats(verifier_rows(spark, 2000))
    drawn = G.conditional_normal(spark, stats, 20_000, 3)
    real = {r["vehicle_class"]: r for r in stats.collect()}
    for r in fee_mileage_stats(drawn.select(
        F.when(F.col("vehicle_class") == "passenger", "1").otherwise("12").alias("vehicle_type"),
        F.col("fee").alias("pay_fee"), F.col("mileage").alias("fee_mileage"), "vehicle_class",
    ).filter("vehicle_class <> 'overall'")).collect():
        if r["vehicle_class"] == "overall":
            continue
        want = real[r["vehicle_class"]]
        assert abs(r["correlation"] - want["correlation"]) < 0.05
        assert abs(r["fee_mean"] - want["fee_mean"]) < 0.05 * want["fee_mean"]


def test_learned_checks(spark):
    ref = verifier_rows(spark)
    model = M.fit_fee_model(ref, trees=20)
    cases = spark.createDataFrame(
        [("12", 3600, "20000", "18000", "2"), ("12", 100, "20000", "18000", "2"), ("12", 3600, "20000", "80000", "2"), ("12", 0, "20000", "18000", "2")],
        ref.schema,
    )
    got = {(r["pay_fee"], r["total_weight"]): r["fee_anomalous"] for r in M.predict_fee(model, cases).collect()}
    assert got == {(3600, "18000"): False, (100, "18000"): True, (3600, "80000"): False, (0, "18000"): True}
    checked = {r["total_weight"]: r for r in M.verify(cases.filter("pay_fee = 3600"), ref, model).collect()}
    assert checked["18000"]["_auxiliary_result"] == "reasonable" and checked["18000"]["_auxiliary_confidence"] > 0.5
    assert checked["80000"]["_auxiliary_result"] == "anomalous" and checked["80000"]["pay_fee"] == 3600
    fixed = M.verify(cases.filter("pay_fee = 100"), ref, model).head()
    assert abs(fixed["pay_fee"] - 3600) < 600 and fixed["_auxiliary_confidence"] == 0.0
    share = M.distance_anomaly(ref, ref).agg(F.avg(F.col("distance_anomalous").cast("int"))).head()[0]
    assert abs(share - 0.1) < 0.01


def test_isolation_forest_flags_planted_rows(views):
    from tollmill.operators import forest as I

    ref = M.features(views.even).select("gantry_transaction_id", *[f"f_{f}" for f in M.FEATURES])
    columns = {f: F.col(f"f_{f}") for f in M.FEATURES}
    odd = ref.limit(5).withColumns({f"f_{f}": F.lit(9e6) for f in M.FEATURES})
    one = I.isolation_anomaly(odd, ref, columns, "gantry_transaction_id", trees=20, size=64).select("isolation_anomalous", "isolation_score")
    assert all(r[0] and r[1] > 0.5 for r in one.collect())
    marked = lambda r: I.isolation_anomaly(r, r, columns, "gantry_transaction_id", trees=20, size=64)
    first = values(marked(ref), "gantry_transaction_id", "isolation_score", "isolation_anomalous")
    assert first == values(marked(ref.repartition(13)), "gantry_transaction_id", "isolation_score", "isolation_anomalous")
    assert abs(sum(r[2] for r in first) / len(first) - 0.1) < 0.01
    assert marked(ref.limit(0)).count() == 0 and not I.isolation_anomaly(odd, ref.limit(0), columns, "gantry_transaction_id").filter("isolation_anomalous").count()


def test_isolation_forest_walks_like_its_rows(spark):
    """The summed way of each row is that of a walk from node to node; list functions are not on the row path."""
    from tollmill.operators import forest as I

    draw = random.Random(7)
    rows = [(f"k{i}", draw.choice([0.0, 1.0, float(i), 1e300]), draw.gauss(0, 1), 5.0) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(3)
    nodes = I.grow(I.draw_samples(df, "k", ["a", "b", "c"], 6, 40), 3, 40)
    walked = I.with_way(df, I.as_arrays(nodes, 40), [F.col(c) for c in "abc"], "way")
    assert "lambda" not in walked._jdf.queryExecution().executedPlan().toString() and walked.columns == [*df.columns, "way"]
    trees = {(r["tree"], r["node"]): r for r in nodes.collect()}

    def way(x):
        total = 0
        for tree in range(6):
            node = 1
            while (tree, node) in trees and trees[tree, node]["feature"] >= 0:
                node = node * 2 + (x[trees[tree, node]["feature"]] >= trees[tree, node]["cut"])
            total += trees[tree, node]["way"] if (tree, node) in trees else (node.bit_length() - 1) * I.UNIT
        return total

    assert values(walked, "k", "way") == sorted([(k, way(x)) for k, *x in rows], key=repr)
