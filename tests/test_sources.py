"""Readers, writers, guarded queries and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from tollmill.functions import constants as K
from tollmill.operators import filters as R
from tollmill.plans.stream_queries import _append
from tollmill.session import scratch_path
from tollmill.sources import dimensions, readers, schemas, sinks
from tollmill.streaming import flows


def test_jdbc_plan_splits_by_day():
    plan = readers.jdbc_plan(section_id="S'1", start="2023-01-01", end="2023-01-04")
    assert len(plan["predicates"]) == 4 and plan["columns"] == K.SAMPLE_FIELDS
    # midnight of the end date belongs to the range
    assert plan["predicates"][3] == "transaction_time = '2023-01-04' AND section_id = 'S''1'"
    assert readers.jdbc_plan(start="2023-01-05", end="2023-01-04")["predicates"] == ["1 = 0"]
    assert plan["predicates"][0] == (
        "transaction_time >= '2023-01-01' AND transaction_time < '2023-01-02' AND section_id = 'S''1'"
    )
    for half in ({}, {"start": "2023-01-01"}, {"end": "2023-01-01"}):
        with pytest.raises(ValueError):
            readers.jdbc_plan(**half)


def test_json_array(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps([{"vehicle_type": 1, "pay_fee": "27"}, {"vehicle_type": "12", "section_id": "S1"}]))
    got = readers.read_samples(spark, str(path))
    assert values(got, "vehicle_type", "pay_fee", "section_id") == sorted([("1", "27", None), ("12", None, "S1")], key=repr)


def test_csv_has_a_header_and_mark(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame([("一", 1)], "`名` string, n int").withColumn("_x", F.lit(1)), path)
    parts = [p.read_bytes() for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    assert all(p.startswith("\ufeff名,n".encode()) for p in parts)
    assert sum("一,1".encode() in p for p in parts) == 1


def test_dimensions(spark):
    gantry = spark.createDataFrame([("g1", "s1"), ("g2", "s9")], "gantry_id string, section_id string")
    section = spark.createDataFrame([("s1", "one")], "section_id string, section_name string")
    assert values(dimensions.map_gantries(gantry, section), "gantry_id", "section_name") == [("g1", "one"), ("g2", None)]


def test_schemas():
    assert schemas.GANTRY_TRANSACTION["pay_fee"].dataType.simpleString() == "int"
    assert schemas.EXIT["toll_money"].dataType.simpleString() == "decimal(10,2)"
    assert set(K.SAMPLE_FIELDS) <= set(schemas.GANTRY_TRANSACTION.names)


def test_guarded_select(spark):
    spark.range(500).withColumn("created_at", F.lit(1)).withColumn("total_limit", F.lit(2)).createOrReplaceTempView("guarded")
    assert R.safe_select(spark, "select created_at, total_limit from guarded;", limit=100).count() == 100
    assert R.safe_select(spark, "select created_at, total_limit from guarded;").count() == 500
    assert R.safe_select(spark, "SELECT id FROM guarded LIMIT 300").count() == 300
    for bad in ("drop table x", "select 1; DROP TABLE x", "select * from x where delete", "with a as (select 1) select * from a"):
        with pytest.raises(ValueError):
            R.safe_select(spark, bad)


def test_bare_end_date_is_midnight(spark):
    df = spark.createDataFrame([("2023-01-03 00:00:00",), ("2023-01-03 12:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert R.between_closed(df, "t", "2023-01-03", "2023-01-03").count() == 1
    assert R.between_half_open(df, "t", "2023-01-03", "2023-01-03").count() == 0


def test_pages_beyond_the_end_are_empty(spark):
    from tollmill.operators.ordering import page, page_info

    df = spark.range(101)
    assert page(df, ["id"], 3, 50).count() == 1 and page(df, ["id"], 4, 50).count() == 0
    assert tuple(page_info(df, 1, 50).head()) == (1, 50, 101, 3)


def _wave(spark, path, hours):
    rows = [(f"E{h}-{i}", "S1", "11", f"2023-01-03 {h:02}:{i:02}:00") for h in hours for i in range(3)]
    df = spark.createDataFrame(rows, "entrance_transaction_id string, section_id string, vehicle_class string, entrance_time string")
    df.withColumn("entrance_time", F.col("entrance_time").cast("timestamp_ntz")).write.mode("append").parquet(path)


def test_hourly_flow_over_two_runs(spark):
    source, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    _wave(spark, source, [1, 2])
    schema = spark.read.parquet(source).schema
    flows.run_hourly_flow(spark.readStream.schema(schema).parquet(source), out, state)
    _wave(spark, source, [2, 3])  # hour 2 is still open and grows
    flows.run_hourly_flow(spark.readStream.schema(schema).parquet(source), out, state)
    got = values(flows.latest_flow(spark.read.parquet(out)), "hour", "truck_count")
    assert got == [("2023-01-03 01", 3), ("2023-01-03 02", 6), ("2023-01-03 03", 3)]


def test_pairs_beyond_the_bound_are_left_out(spark):
    path = scratch_path(spark, "calls")
    spark.createDataFrame([("a", "2023-01-03 01:00:00", "2023-01-03 01:00:02"), ("b", "2023-01-03 01:00:00", "2023-01-03 04:00:00")],
                          "trace_id string, created_at string, ended_at string").write.parquet(path)
    stream = spark.readStream.schema("trace_id string, created_at string, ended_at string").parquet(path)
    timed = stream.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "ended_at")})
    ends = timed.select("trace_id", "ended_at").withColumn("response_status", F.lit(404))
    paired = flows.stream_pair_audit(timed.select("trace_id", "created_at"), ends)

    class V:
        pass

    v = V()
    v.spark = spark
    assert values(_append(paired, v), "trace_id", "response_time_ms", "is_success") == [("a", 2000, False)]
