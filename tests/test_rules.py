"""Rules, repairs and scores on single rows."""

from pyspark.sql import functions as F

from tests.conftest import SAMPLE_SCHEMA, sample, values
from tollmill.functions import constants as K
from tollmill.operators import exemplars as X
from tollmill.operators import fidelity as E
from tollmill.operators import quality as Q


def found(frame, **changes):
    return list(Q.check_rules(frame([sample(**changes)], SAMPLE_SCHEMA)).head()["issues"])


def test_rule_issues(frame):
    assert found(frame) == []
    assert found(frame, entrance_time=None) == [K.ISSUE_TIME_FORMAT]
    assert found(frame, entrance_time="2023-02-01T09:45:10") == [K.ISSUE_TIME_ORDER]
    assert found(frame, entrance_time="2023-02-01T03:45:09") == [K.ISSUE_TIME_LONG]
    assert found(frame, entrance_time="2023-02-01T03:45:10") == []
    assert found(frame, discount_fee=2701) == [K.ISSUE_FEE]
    assert found(frame, discount_fee=None) == [K.ISSUE_FEE_FORMAT]
    assert found(frame, vehicle_type="bus") == [K.ISSUE_VEHICLE_FORMAT]
    assert found(frame, axle_count="2.0") == [K.ISSUE_AXLE]
    assert found(frame, vehicle_type="12", total_weight="27001") == [K.ISSUE_WEIGHT]
    assert found(frame, vehicle_type="12", total_weight="27000") == []
    assert found(frame, pay_fee=0, discount_fee=0) == [K.ISSUE_MISSING]


def gantries(spark):
    rows = [("G761153001000110010", "G7611530010", "都香高速"), ("G000000001000110010", "G0000000010", "a road")]
    return spark.createDataFrame(rows, "gantry_id string, section_id string, section_name string")


def dates_of_sections(spark):
    return spark.createDataFrame([("G7611530010", "2023-02-01"), ("S0010530010", "2023-02-20")], "section_id string, date string")


def test_scores_by_issue_count(frame):
    rows = [sample(), sample(axle_count="3"), sample(axle_count="3", discount_fee=9999), sample(axle_count="3", discount_fee=9999, entrance_time=None)]
    scored = Q.check_rules(frame(rows, SAMPLE_SCHEMA))
    assert [r["n_issues"] for r in scored.collect()] == [0, 1, 2, 3]
    assert Q.accept(scored).count() == 3


def test_repair_and_recovery(spark, frame):
    bad = sample(axle_count="9", discount_fee=9999, entrance_time="2023-02-01T11:00:00", section_id="S0010530010", section_name="x")
    lost = sample(gantry_transaction_id="T2", gantry_id="nowhere")
    fixed = {r["gantry_transaction_id"]: r for r in Q.repair(frame([bad, lost], SAMPLE_SCHEMA), gantries(spark)).collect()}
    row = fixed["T1"]
    assert (row["axle_count"], row["discount_fee"], row["section_id"], row["section_name"]) == ("2", 135, "G7611530010", "都香高速")
    assert row["entrance_time"] < row["transaction_time"] and not row["_gantry_unknown"]
    assert fixed["T2"]["_gantry_unknown"] and fixed["T2"]["section_id"] == "G7611530010"
    kept = Q.recover(frame([bad, sample(gantry_transaction_id="T3")], SAMPLE_SCHEMA), gantries(spark))
    assert values(kept, "gantry_transaction_id", "_recovered") == [("T1", True), ("T3", False)]


def test_medium_is_compared_as_a_number(frame):
    rows = frame([sample(discount_fee=0)], SAMPLE_SCHEMA)
    assert Q.fill_knowledge(rows).head()["discount_fee"] == 135
    text = rows.withColumn("media_type", F.col("media_type").cast("string"))
    assert Q.fill_knowledge(text).head()["discount_fee"] == 0
    assert Q.fill_knowledge(text, media_text=True).head()["discount_fee"] == 135


def test_overweight_state(frame):
    heavy = frame([sample(vehicle_type="12", axle_count="3", total_weight="28000")], SAMPLE_SCHEMA)
    assert Q.fill_knowledge(heavy).head()["pass_state"] == "2"


def test_section_dates(spark, frame):
    dates = dates_of_sections(spark)
    rows = [sample(), sample(gantry_transaction_id="T2", transaction_time="2023-02-02T01:00:00"), sample(gantry_transaction_id="T3", section_id="unknown")]
    assert values(Q.section_date_errors(frame(rows, SAMPLE_SCHEMA), dates), "gantry_transaction_id") == [("T2",)]


def test_structure_sample_has_a_wrong_date(spark, frame):
    row = sample(section_id="S0010530010", transaction_time="2023-03-15T10:00:00", entrance_time="2023-03-15T09:00:00")
    got = E.faithfulness(frame([row], SAMPLE_SCHEMA), dates_of_sections(spark)).head()
    assert (got["valid_count"], got["section_date_errors"], got["score"]) == (0, 1, 0.0)


def test_weights(frame):
    rows = [sample(vehicle_type="1")] * 3 + [sample(vehicle_type="12")]
    got = {r["vehicle_type"]: r["_quality_weight"] for r in Q.static_weights(frame(rows, SAMPLE_SCHEMA)).collect()}
    assert abs(got["1"] - 0.4 / 0.75) < 1e-12 and abs(got["12"] - 0.6 / 0.25) < 1e-12
    for n in (20, 21, 30):  # small tables are weighted like large ones
        out = Q.iterative_weights(frame([sample(gantry_transaction_id=f"T{i:03}") for i in range(n)], SAMPLE_SCHEMA))
        weights = sorted(r["_quality_weight"] for r in out.collect())
        assert weights.count(1.0) == n - int(n * 0.8) and abs(weights[0] - 0.4 * 1.1**5) < 1e-12


def test_verify_vehicle(frame):
    rows = [sample(axle_count="255", total_weight="0"), sample(gantry_transaction_id="T2", vehicle_type="13", axle_count="2", total_weight="20000")]
    got = {r["gantry_transaction_id"]: r for r in Q.verify_vehicle(frame(rows, SAMPLE_SCHEMA)).collect()}
    assert got["T1"]["axle_count"] == "2" and 2500 <= int(got["T1"]["total_weight"]) <= 4500
    assert got["T1"]["_auxiliary_fixed"] == "total_weight"
    assert (got["T2"]["axle_count"], got["T2"]["_auxiliary_fixed"], got["T2"]["total_weight"]) == ("3", "axle_count", "20000")


def test_zscore_fix(frame):
    ref = frame([sample(pay_fee=p) for p in (90, 100, 110)], SAMPLE_SCHEMA)
    fixed = Q.zscore_fix(frame([sample(pay_fee=500), sample(pay_fee=105)], SAMPLE_SCHEMA), ref, ["pay_fee"])
    assert sorted((r["pay_fee"], len(r["_corrections"])) for r in fixed.collect()) == [(100, 1), (105, 0)]


def test_exemplar_scores(frame):
    truck = sample(vehicle_type="12", axle_count="3", total_weight="28000", pass_state="2", pay_fee=3540, discount_fee=0)
    rows = frame([truck], SAMPLE_SCHEMA)
    assert abs(X.exemplar_quality(rows).head()["quality"] - 1.0) < 1e-12
    condition = {"vehicle_type": K.TRUCK, "scenario": K.OVERLOADED, "time_period": K.MORNING_PEAK}
    assert abs(X.similarity(rows, condition).head()["similarity"] - 0.7) < 1e-12
    assert abs(X.similarity(rows, {}).head()["similarity"] - 0.5) < 1e-12
    assert abs(X.difficulty(rows).head()["difficulty"] - 1.0) < 1e-12  # 0.5 + 0.15 + 0.2 + 0.15 + 0.1, capped at 1


def test_exemplars_are_distinct(frame):
    rows = [sample(gantry_transaction_id=f"T{i}", fee_mileage=str(60000 + i)) for i in range(10)]
    picked = X.select_exemplars(frame(rows, SAMPLE_SCHEMA), {}, 3, ["gantry_transaction_id"])
    ids = [r["gantry_transaction_id"] for r in picked.orderBy("pick").collect()]
    assert ids[0] == "T0" and ids[1] == "T5" and len(set(ids)) == 3
    few = X.select_exemplars(frame(rows[:2], SAMPLE_SCHEMA), {}, 5, ["gantry_transaction_id"])
    assert few.count() == 2


def test_identical_tables_are_fully_similar(frame):
    rows = frame([sample(gantry_transaction_id=f"T{i}", pay_fee=100 + 7 * i, fee_mileage=str(1000 + i * i)) for i in range(40)], SAMPLE_SCHEMA)
    got = E.benchmark_similarity(rows, rows).head()
    assert abs(got["overall_similarity"] - 1.0) < 1e-9 and got["verdict"] == "优秀"


def test_fee_task_falls_back_to_the_usual_ratio(frame):
    got = E.task_fee(frame([sample(pay_fee=1100, fee_mileage="10000")], SAMPLE_SCHEMA)).head()
    assert got["accuracy"] == 1.0 and got["samples_evaluated"] == 1


def test_by_weight_spreads_rows_of_one_weight(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 5, 2.0).otherwise(1.0).alias("_quality_weight"), F.create_map(F.lit("a"), "id").alias("m"))
    ranked = Q.by_weight(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranked.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.columns == rows.columns and max(r["count"] for r in parts) < 2000
    got = [(r["id"], r["_quality_weight"]) for r in ranked.collect()]
    assert {i for i, _ in got[:5]} == set(range(5)) and sorted(i for i, _ in got) == list(range(4000))


def test_iterative_weights_of_each_class_and_score(frame):
    """Weights by hand for both classes and four numbers of issues, and for a head without trucks."""
    bad = [{}, {"axle_count": "3"}, {"axle_count": "3", "discount_fee": 9999}, {"axle_count": "3", "discount_fee": 9999, "entrance_time": None}]
    truck = [{}, {"discount_fee": 9999}, {"discount_fee": 9999, "entrance_time": None}, {"discount_fee": 9999, "entrance_time": None, "total_weight": "99999"}]
    rows = [sample(gantry_transaction_id=f"P{i}", **c) for i, c in enumerate(bad * 3)] + [sample(gantry_transaction_id=f"T{i}", vehicle_type="12", **c) for i, c in enumerate(truck)]

    def want(start, n):
        for _ in range(5):
            start = min(3.0, max(0.1, start * (1.1 if n <= 1 else 0.9 if n >= 3 else 1.0)))
        return round(start, 9)

    got = Q.iterative_weights(frame(rows, SAMPLE_SCHEMA), order=["gantry_transaction_id"], head=1.0)
    for r in got.collect():
        start = min(3.0, 0.6 / (4 / 16)) if r["vehicle_type"] == "12" else 0.4 / (12 / 16)
        assert round(r["_quality_weight"], 9) == want(start, r["n_issues"])
    alone = Q.iterative_weights(frame(rows[:4], SAMPLE_SCHEMA), order=["gantry_transaction_id"], head=1.0)
    assert [round(r["_quality_weight"], 9) for r in alone.orderBy("gantry_transaction_id").collect()] == [want(0.4, n) for n in range(4)]


def test_appended_scores_go_through_the_rules_once(spark, views):
    """Both parts of s2_append_recovered read the stored numbers; neither is a filter over the rules."""
    from tollmill.plans import quality_queries

    plan = quality_queries.s2(views)._jdf.queryExecution().executedPlan().toString()
    assert "timestampdiff" not in plan and plan.count("lineitem") == 0
