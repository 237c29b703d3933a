"""Profiles of tables and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.operators import profiling as P
from tollmill.operators.quality import zscore_fix
from tollmill.plans.registry import moment, period, query, six, sql_moment, sql_shown


def _each(template: str, cols) -> str:
    """One SELECT per column, joined by UNION ALL."""
    return " union all ".join(template.replace("{c}", c) for c in cols)


ALL_FIELDS = [
    "gantry_transaction_id", "gantry_id", "section_id", "vehicle_type", "transaction_time", "entrance_time", "pay_fee", "discount_fee",
    "fee_mileage", "axle_count", "total_weight", "media_type", "pass_state", "ok",
]


@query("a22_value_frequency", _each("""
    select '{c}' as field, cast({c} as varchar) as value, count(*) as cnt from v_gtx where {c} is not null group by 2""", ALL_FIELDS))
def a22(v):
    return P.value_frequency(v.gtx, ALL_FIELDS)


@query("a23_min_max", _each("""
    select '{c}' as field, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from v_gtx""",
    ALL_FIELDS))
def a23(v):
    return P.min_max(v.gtx, ALL_FIELDS)


@query("a24_joint_frequency", """
    select vehicle_type, axle_count, count(*) as cnt from v_gtx
    where vehicle_type is not null and axle_count is not null group by 1, 2""")
def a24(v):
    return P.joint_frequency(v.gtx, "vehicle_type", "axle_count")


@query("a25_conditional_probability", """
    select vehicle_type, axle_count, count(*) as cnt, count(*) / sum(count(*)) over ()::double as joint_prob,
           count(*) / sum(count(*)) over (partition by vehicle_type)::double as cond_prob
    from v_gtx group by 1, 2""")
def a25(v):
    return P.conditional_probability(v.gtx, "vehicle_type", "axle_count")


@query("a26_fd_violations", """
    select vehicle_type, count(distinct axle_count) as n_values from v_gtx group by 1 having count(distinct axle_count) > 1""")
def a26(v):
    return P.fd_violations(v.gtx, "vehicle_type", "axle_count")


@query("a26_gantry_section_dependency", """
    select gantry_id, count(distinct section_id) as n_values from v_gtx group by 1 having count(distinct section_id) > 1""")
def a26_gantry(v):
    return P.fd_violations(v.gtx, "gantry_id", "section_id")


@query("a27_daily_counts", """
    select strftime(entrance_time, '%Y-%m-%d') as date, count(*) as cnt from v_gtx where entrance_time is not null group by 1""")
def a27(v):
    return P.daily_counts(v.gtx, "entrance_time")


@query("a27_date_span", f"""
    select count(entrance_time) as total_records, count(distinct strftime(entrance_time, '%Y-%m-%d')) as distinct_days,
           {sql_moment('min(entrance_time)')} as earliest, {sql_moment('max(entrance_time)')} as latest from v_gtx""")
def a27_span(v):
    return P.date_span(v.gtx, "entrance_time").withColumns({"earliest": moment("earliest"), "latest": moment("latest")})


@query("a28_section_counts", "select section_id, section_name, count(*) as cnt from v_gtx group by 1, 2")
def a28(v):
    return P.section_counts(v.gtx_named)


@query("a29_profile_categorical", _each("""
    select '{c}' as field, {c} as value, count(*) as cnt, count(*) / sum(count(*)) over ()::double as prob
    from v_gtx where {c} is not null group by 2""", ["vehicle_type", "media_type", "pass_state", "axle_count"]))
def a29(v):
    return P.profile_categorical(v.gtx)


_NUM = "try_cast({c} as double)"


def _numeric_sql(std: str) -> str:
    return _each(f"""
        select '{{c}}' as field, count({_NUM}) as n, min({_NUM}) as min, max({_NUM}) as max, round(avg({_NUM}), 6) as mean,
               round({std}({_NUM}), 6) as std, quantile_cont({_NUM}, 0.25) as p25, quantile_cont({_NUM}, 0.5) as p50,
               quantile_cont({_NUM}, 0.75) as p75
        from v_gtx""", K.NUMERIC_FIELDS)


@query("a30_profile_numeric", _numeric_sql("stddev_pop"))
def a30(v):
    return six(P.profile_numeric(v.gtx), "mean", "std")


@query("a31_profile_datetime", " union all ".join(f"""
    select '{c}' as field, '{unit}' as unit, cast({expr.format(c)} as int) as value, count(*) as cnt,
           count(*) / sum(count(*)) over ()::double as prob
    from v_gtx where {c} is not null group by 3"""
    for c in K.DATETIME_FIELDS for unit, expr in (("hour", "hour({})"), ("weekday", "isodow({}) - 1"))))
def a31(v):
    return P.profile_datetime(v.gtx)


@query("a32_class_period_mix", f"""
    with c as (
    select 'vehicle' as field, case when vehicle_type in ('0','1','2','3','4','5') then '客车' else '货车' end as value,
           count(*) as cnt
    from v_gtx where vehicle_type is not null and vehicle_type <> '' group by 2
    union all
    select 'time', case when hour(transaction_time) between 7 and 8 then '早高峰' when hour(transaction_time) between 17 and 18 then '晚高峰'
                        when hour(transaction_time) < 6 then '深夜' else '平峰' end,
           count(*)
    from v_gtx where transaction_time is not null group by 2),
    t as (select *, sum(cnt) over (partition by field) as total from c)
    select field, value, cnt, {sql_shown('cnt', 'total', 2)} as share from t""")
def a32(v):
    return P.class_period_mix(v.gtx)


_PAIRS = """p as (select case when vehicle_type in ('1','2','3','4','5') then 'passenger' else 'truck' end as vehicle_class,
                        cast(pay_fee as bigint) as fee, coalesce(cast(trunc(try_cast(fee_mileage as double)) as bigint), 0) as mileage from v_gtx)"""
_SPREAD = """cast(trunc(avg({0})) as bigint) as {0}_mean, cast(trunc(stddev_pop({0})) as bigint) as {0}_std,
             min({0}) as {0}_min, max({0}) as {0}_max"""


@query("a33_fee_mileage_stats", f"""
    with {_PAIRS}
    select coalesce(vehicle_class, 'overall') as vehicle_class, {_SPREAD.format('fee')}, {_SPREAD.format('mileage')},
           round(corr(fee, mileage), 6) as correlation, count(*) as sample_count
    from p where fee > 0 and mileage > 0 group by rollup (vehicle_class)""")
def a33(v):
    return six(P.fee_mileage_stats(v.gtx), "correlation")


@query("a33_fee_mileage_overall", f"""
    with p as (select case when pay_fee <> 0 then cast(pay_fee as bigint) end as fee,
                      cast(trunc(try_cast(nullif(fee_mileage, '') as double)) as bigint) as mileage from v_gtx)
    select {_SPREAD.format('fee')}, {_SPREAD.format('mileage')} from p""")
def a33_overall(v):
    return P.fee_mileage_overall(v.gtx)


@query("a34_section_dates", """
    select distinct section_id, strftime(transaction_time, '%Y-%m-%d') as date from v_gtx
    where section_id <> '' and transaction_time is not null
    union select section_id, '2030-01-01' from v_gtx""")
def a34(v):
    presets = v.section.select("section_id", F.lit("2030-01-01").alias("date"))
    return P.section_dates(v.gtx, presets)


@query("a34_section_date_ranges", """
    select section_id, count(distinct strftime(transaction_time, '%Y-%m-%d')) as n_dates,
           min(strftime(transaction_time, '%Y-%m-%d')) as first_date, max(strftime(transaction_time, '%Y-%m-%d')) as last_date
    from v_gtx group by 1""")
def a34_ranges(v):
    return P.section_date_ranges(P.section_dates(v.gtx))


@query("a35_diversity_counts", f"""
    select count(distinct vehicle_type) as n_vehicle_type, count(distinct gantry_id) as n_gantry_id,
           count(distinct section_id) as n_section_id, count(distinct gantry_transaction_id) as n_gantry_transaction_id,
           count(distinct {period('transaction_time')}) as n_time_period, count(*) as n_rows,
           count(distinct gantry_transaction_id) / count(*)::double as uniqueness
    from v_gtx""")
def a35(v):
    return P.diversity_counts(v.gtx)


@query("a36_coverage", """
    select count(distinct vehicle_type) / 4::double as coverage from v_gtx where vehicle_type in ('11', '16', '22', '25')""")
def a36(v):
    return P.coverage(v.gtx, ["11", "16", "22", "25"], F.col("vehicle_type"))


@query("a37_summarize", """
    select count(*) as count, cast(sum(toll_money) as double) as total_toll_fee,
           cast(sum(toll_money) as double) / count(*) as average_toll_fee, cast(sum(real_money) as double) as total_real_money,
           count(distinct section_id) as unique_sections,
           (select string_agg(section_id, ',' order by section_id) from
              (select distinct section_id from v_exit order by 1 limit 10)) as sections
    from v_exit""")
def a37(v):
    return P.summarize(v.exit, listed=10).withColumn("sections", F.concat_ws(",", "sections"))


@query("a37_summarize_flow", """
    with c as (select section_id, strftime(entrance_time, '%Y-%m-%d %H') as hour, count(*) as truck_count
               from v_entrance where vehicle_class in ('11','12','13','14','15','16') group by 1, 2)
    select cast(sum(truck_count) as bigint) as total_truck_count, avg(truck_count) as average_truck_count from c""")
def a37_flow(v):
    from tollmill.operators.analytics import truck_hourly_counts

    return P.summarize_flow(truck_hourly_counts(v.entrance))


@query("a41_export_summary", """
    select count(*) as total_count, count(distinct vehicle_type) as vehicle_types, count(distinct section_id) as section_ids,
           strftime(min(transaction_time), '%Y-%m-%d') as date_min, strftime(max(transaction_time), '%Y-%m-%d') as date_max
    from v_gtx""")
def a41(v):
    return P.export_summary(v.gtx)


@query("a42_chunk_stats", """
    with n as (select cast(toll_money as double) as fee, floor((row_number() over (order by exit_time, exit_transaction_id) - 1) / 50) as chunk from v_exit),
    s as (select cast(chunk as bigint) as chunk, cast(trunc(avg(fee)) as bigint) as fee_mean, cast(trunc(stddev_pop(fee)) as bigint) as fee_std,
                 cast(trunc(min(fee)) as bigint) as fee_min, cast(trunc(max(fee)) as bigint) as fee_max, count(*) as count from n group by 1)
    select *, case when count >= 5 and abs(fee_mean - 200000) / 200000.0::double > 0.2
                   then case when fee_mean < 200000 then 'low' else 'high' end end as hint from s""")
def a42(v):
    rows = v.exit.select("exit_time", "exit_transaction_id", "toll_money")
    return P.chunk_stats(rows, ["exit_time", "exit_transaction_id"], 50, 200000, "toll_money", None)


@query("a44_correction_rate", """
    with s as (select avg(pay_fee) as m, stddev_samp(pay_fee) as d from v_gtx where ok % 2 = 0),
    c as (select abs(pay_fee - m) / (d + 1e-10) > 1.5 as far from v_gtx, s where ok % 2 = 1)
    select count(*) as checked, count(case when far then 1 end) as corrected, 0::bigint as anomalous,
           count(case when far then 1 end) / count(*)::double as correction_rate from c""")
def a44(v):
    return P.correction_rate(zscore_fix(v.odd, v.even, ["pay_fee"], 1.5))
