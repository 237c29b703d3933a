"""Scans, sinks and splits (SRC*, SNK*, SPL*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.operators import filters as R
from tollmill.plans.registry import moment, query, sql_key, sql_moment
from tollmill.session import scratch_path
from tollmill.sources import dimensions, readers, sinks, splits

_NAMES = ["section", "station", "gantry", "entrance", "exit", "gtx", "audit"]


@query("src1_scan_counts", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count from v_{n}" for n in _NAMES))
def src1(v):
    parts = [getattr(v, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in _NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("src2_get_by_key", "select gantry_id, gantry_name, section_id from v_gantry where gantry_id = 'GT00000007'")
def src2(v):
    return readers.get(v.gantry, "gantry_id", "GT00000007").select("gantry_id", "gantry_name", "section_id")


_SAMPLE = ["gantry_transaction_id", "gantry_id", "section_id", "vehicle_type", "axle_count", "total_weight", "fee_mileage"]
_SAMPLE_SQL = f"select {', '.join(_SAMPLE)} from v_gtx"


def _json_copy(v):
    path = scratch_path(v.spark, "samples")
    sinks.write_json(v.gtx.select(*_SAMPLE, F.lit("x").alias("_internal")), path)
    return path


@query("src5_read_samples", _SAMPLE_SQL)
def src5(v):
    return readers.read_samples(v.spark, _json_copy(v), multi_line=False).select(*_SAMPLE)


_DRAWN = ["gantry_transaction_id", "gantry_id", "vehicle_type", "pay_fee", "ok"]


@query("src6_sample_n", f"""
    with r as (select *, row_number() over (order by {sql_key(42, *_DRAWN)}, {', '.join(_DRAWN)}) as rn from v_gtx)
    select gantry_transaction_id, vehicle_type, pay_fee from r where rn <= 1000""")
def src6(v):
    return readers.sample_n(v.gtx.select(*_DRAWN), 1000, 42).select("gantry_transaction_id", "vehicle_type", "pay_fee")


@query("src7_first_n", "select exit_transaction_id from v_exit order by exit_transaction_id limit 5000")
def src7(v):
    return readers.first_n(v.exit, 5000, "exit_transaction_id").select("exit_transaction_id")


@query("src8_gantry_dimension", "select gantry_id, section_id, section_name from v_gantry")
def src8(v):
    return dimensions.map_gantries(v.gantry, v.section).select("gantry_id", "section_id", "section_name")


@query("src9_profile_catalog", " union all ".join(
    f"select 'toll_{n}' as table_name, (select count(*) from (describe select * from v_{n}) where column_name <> 'nk' and not ('{n}' = 'gantry' and column_name = 'section_name'))::int as n_columns, "
    f"count(*) as row_count, 3 as n_samples from v_{n}" for n in _NAMES))
def src9(v):
    for name in _NAMES:
        (v.gtx_named if name == "gtx" else getattr(v, name)).createOrReplaceTempView(f"toll_{name}")
    profile = readers.profile_catalog(v.spark, [f"toll_{n}" for n in _NAMES])
    return profile.select(
        "table_name", F.size("columns").alias("n_columns"), "row_count", F.size("sample_rows").alias("n_samples")
    )


@query("src10_preview", f"""
    select gantry_transaction_id, vehicle_type, section_id, {sql_moment('transaction_time')} as transaction_time, pay_fee, fee_mileage
    from v_gtx order by v_gtx.transaction_time, gantry_transaction_id, pay_fee limit 20""")
def src10(v):
    rows = v.gtx.orderBy("transaction_time", "gantry_transaction_id", "pay_fee")
    return readers.preview(rows, 20).withColumn("transaction_time", moment("transaction_time"))


@query("snk1_write_json", "select section_id, count(*) as cnt from v_gtx group by 1")
def snk1(v):
    back = v.spark.read.schema("section_id string").json(_json_copy(v))
    return back.groupBy("section_id").agg(F.count(F.lit(1)).alias("cnt"))


@query("snk2_write_csv", "select exit_transaction_id, vehicle_class, coalesce(section_id, '') as section_id from v_exit")
def snk2(v):
    path = scratch_path(v.spark, "exits")
    sinks.write_csv(v.exit.select("exit_transaction_id", "vehicle_class", "section_id"), path, bom=False)
    schema = "exit_transaction_id string, vehicle_class string, section_id string"
    return v.spark.read.schema(schema).option("header", True).csv(path)


@query("snk3_write_text", """
    select vehicle_type || ',' || axle_count || ',' || cast(count(*) as varchar) as value from v_gtx group by vehicle_type, axle_count
    union all select 'vehicle_type,axle_count,count'
    union all select 'total_records: ' || cast(count(*) as varchar) from v_gtx""")
def snk3(v):
    from tollmill.operators.profiling import joint_report

    path = scratch_path(v.spark, "report")
    sinks.write_text(joint_report(v.gtx, "vehicle_type", "axle_count"), path)
    return v.spark.read.text(path)


@query("snk4_drop_internal", "select section_id, section_name from v_section")
def snk4(v):
    return sinks.drop_internal(v.section.withColumn("_quality_weight", F.lit(1.0)).withColumn("_note", F.lit("x")))


@query("snk5_append_audit", "select id, trace_id, 'start' as kind from v_audit union all select id, trace_id, 'end' from v_audit")
def snk5(v):
    path = scratch_path(v.spark, "audit")
    for kind in ("start", "end"):
        sinks.append_audit(v.audit.select("id", "trace_id", F.lit(kind).alias("kind")), path)
    return v.spark.read.parquet(path)


@query("spl1_split_random", f"""
    select exit_transaction_id,
           case when cast('0x' || left({sql_key(42, 'exit_transaction_id')}, 12) as bigint) < {int(0.8 * (1 << 48))} then 'train' else 'test' end as side
    from v_exit""")
def spl1(v):
    train, test = splits.split_random(v.exit.select("exit_transaction_id"))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


_HEAD = "case when row_number() over (order by exit_transaction_id) <= floor(count(*) over () * {0}::double) then 'head' else 'rest' end"


@query("spl2_split_head", f"select exit_transaction_id, {_HEAD.format('0.8')} as side from v_exit")
def spl2(v):
    head, rest = splits.split_head(v.exit.select("exit_transaction_id"), "exit_transaction_id", 0.8)
    return head.withColumn("side", F.lit("head")).unionByName(rest.withColumn("side", F.lit("rest")))


@query("spl2_split_half", f"select exit_transaction_id, {_HEAD.format('0.5')} as side from v_exit")
def spl2_half(v):
    head, rest = splits.split_head(v.exit.select("exit_transaction_id"), "exit_transaction_id", 0.5)
    return head.withColumn("side", F.lit("head")).unionByName(rest.withColumn("side", F.lit("rest")))


@query("src3_projected_scan", """
    select gantry_transaction_id, gantry_id, section_id, vehicle_type from v_gtx
    where section_id = 'G1000000005' and transaction_time >= timestamp '1997-01-01' and transaction_time < timestamp '1998-01-01'""")
def src3(v):
    rows = R.between_half_open(R.where_opt(v.gtx, section_id="G1000000005"), "transaction_time", "1997-01-01", "1998-01-01")
    return rows.select("gantry_transaction_id", "gantry_id", "section_id", "vehicle_type")
