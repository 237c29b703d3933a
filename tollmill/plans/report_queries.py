"""Traffic, revenue and truck reports."""

from __future__ import annotations

from tollmill.operators import analytics as A
from tollmill.operators.relational import with_section_name
from tollmill.plans.registry import TRUCKS, query, six, sql_noisy, sql_shown, sql_uniform

DAY = "strftime({0}, '%Y-%m-%d')"
MONEY = "coalesce(cast(sum({0}) as double), 0)"
MEAN = "coalesce(cast(sum({0}) as double) / nullif(count({0}), 0), 0)"
WHOLE10 = "try_cast({0} as decimal(10,0))"
START, END = "1996-01-01", "1998-06-30"


@query("a1_traffic_flow", f"""
    select {DAY.format('entrance_time')} as date, vehicle_class, count(*) as count
    from v_entrance group by 1, 2""")
def a1(v):
    return A.traffic_flow(v.entrance)


@query("a1_traffic_flow_filtered", f"""
    select {DAY.format('entrance_time')} as date, vehicle_class, count(*) as count
    from v_entrance where section_id = 'G1000000005' and entrance_time >= timestamp '{START}'
         and entrance_time <= timestamp '{END}' group by 1, 2""")
def a1_filtered(v):
    return A.traffic_flow(v.entrance, "G1000000005", START, END)


@query("a2_revenue", f"""
    select {DAY.format('exit_time')} as date, count(*) as transaction_count, {MONEY.format('toll_money')} as total_toll,
           {MONEY.format('real_money')} as total_real_money, {MEAN.format('toll_money')} as avg_toll
    from v_exit group by 1""")
def a2(v):
    return A.revenue(v.exit)


@query("a3_vehicle_distribution", f"""
    with c as (select vehicle_class, count(*) as count from v_entrance group by 1), t as (select *, sum(count) over () as total from c)
    select vehicle_class, count, {sql_shown('count', 'total', 2, 100)} as percentage from t""")
def a3(v):
    return A.vehicle_distribution(v.entrance)


_HOURLY = f"""
    select e.section_id, s.section_name, strftime(entrance_time, '%Y-%m-%d %H') as hour, count(*) as truck_count
    from v_entrance e join v_section s on e.section_id = s.section_id
    where vehicle_class in {TRUCKS} group by 1, 2, 3"""


@query("a4_truck_hourly_flow", _HOURLY)
def a4(v):
    return with_section_name(A.truck_hourly_counts(v.entrance), v.section).select("section_id", "section_name", "hour", "truck_count")


@query("a4_truck_hourly_flow_noisy", f"""
    with h as ({_HOURLY}), u as (select *, {sql_uniform(7, 'section_id', 'hour')} - 0.5::double as u from h)
    select section_id, section_name, hour, {sql_noisy('truck_count')} as truck_count_dp, 1.0::double as epsilon, 'Laplace' as dp_method from u""")
def a4_noisy(v):
    return A.truck_hourly_flow(v.entrance, v.section, seed=7)


@query("a5_avg_travel_time", f"""
    select x.section_id, sum(date_sub('minute', entrance_time, exit_time)) * 1.0::double / count(*) as avg_travel_time_minutes,
           count(*) as sample_count
    from v_exit x join v_entrance e on x.pass_id = e.pass_id and x.section_id = e.section_id
    where x.vehicle_class in {TRUCKS} group by 1""")
def a5(v):
    return A.avg_travel_time(v.exit, v.entrance)


@query("a6_avg_toll_fee", f"""
    select section_id, {MEAN.format('real_money')} as avg_toll_fee, count(*) as transaction_count
    from v_exit where vehicle_class in {TRUCKS} group by 1""")
def a6(v):
    return A.avg_toll_fee(v.exit)


_LANES = f"""sums as (select section_id, sum(cast({WHOLE10.format('lane_count')} as bigint)) as a,
                             count({WHOLE10.format('lane_count')}) as b from v_gantry group by 1),
    lanes as (select section_id, case when a > 0 then a else 4 end as a, case when a > 0 then b else 1 end as b from sums)"""
_AVG_LANES = sql_shown("coalesce(a, 4)", "coalesce(b, 1)", 1)


@query("a7_congestion_index", f"""
    with {_LANES}, t as (
      select g.section_id, count(case when x.vehicle_type in {TRUCKS} then x.gantry_transaction_id end) as truck_count
      from v_gtx x join v_gantry g on x.gantry_id = g.gantry_id group by 1)
    select t.section_id, truck_count, {_AVG_LANES} as avg_lanes,
           {sql_shown('truck_count * coalesce(b, 1)', 'coalesce(a, 4)', 2)} as congestion_index
    from t left join lanes on t.section_id = lanes.section_id""")
def a7(v):
    return A.congestion_index(v.gtx, v.gantry)


@query("a8_exit_hourly_flow", f"""
    select section_id, strftime(exit_time, '%Y-%m-%d %H') as hour, count(*) as truck_count,
           {MEAN.format('real_money')} as avg_toll
    from v_exit where vehicle_class in {TRUCKS} group by 1, 2""")
def a8(v):
    return A.exit_hourly_flow(v.exit)


_USABLE = "{0} is not null and {0} <> '' and {0} <> '0'"


_OVER = f"count(case when {WHOLE10.format('total_weight')} > {WHOLE10.format('total_limit')} then 1 end)"


@query("a9_overweight_rate", f"""
    select left(section_id, 1) || repeat('*', length(section_id) - 2) || right(section_id, 1) as section_id,
           true as section_id_masked, count(*) as total_count,
           count(case when {WHOLE10.format('total_weight')} > {WHOLE10.format('total_limit')} then 1 end) as overweight_count,
           {sql_shown(_OVER, 'count(*)', 4)} as overweight_rate, {sql_shown(_OVER, 'count(*)', 2, 100)} as overweight_percentage
    from v_exit where vehicle_class in {TRUCKS} and {_USABLE.format('total_weight')} and {_USABLE.format('total_limit')}
    group by v_exit.section_id""")
def a9(v):
    return A.overweight_rate(v.exit)


_CUT = "count(case when discount_type is not null and discount_type <> '' then 1 end)"


@query("a10_discount_rate", f"""
    select section_id, count(*) as total_count,
           count(case when discount_type is not null and discount_type <> '' then 1 end) as discount_count,
           {sql_shown(_CUT, 'count(*)', 4)} as discount_rate, {sql_shown(_CUT, 'count(*)', 2, 100)} as discount_percentage
    from v_exit where vehicle_class in {TRUCKS} group by 1""")
def a10(v):
    return A.discount_rate(v.exit)


_PEAKS = f"""
    with h as (select section_id, strftime(entrance_time, '%H') as hour, count(*) as truck_count
               from v_entrance where vehicle_class in {TRUCKS} group by 1, 2),
         r as (select *, row_number() over (partition by section_id order by truck_count desc, hour) as rn from h)
    select section_id, hour, truck_count from r where rn <= 3"""


@query("a11_peak_hours", _PEAKS)
def a11(v):
    return A.peak_hours(v.entrance)


_AXLES = [f"sum(cast({WHOLE10.format('axis_count')} as bigint))", f"nullif(count({WHOLE10.format('axis_count')}), 0)"]


@query("a12_avg_axle_count", f"""
    select section_id, coalesce({sql_shown(_AXLES[0], _AXLES[1], 2)}, 0) as avg_axle_count,
           count(*) as sample_count
    from v_exit where vehicle_class in {TRUCKS} and {_USABLE.format('axis_count')} group by 1""")
def a12(v):
    return A.avg_axle_count(v.exit)


@query("a13_lane_utilization", f"""
    with {_LANES}, t as (
      select g.section_id, count(x.gantry_transaction_id) as total_transactions
      from v_gtx x join v_gantry g on x.gantry_id = g.gantry_id where x.vehicle_type in {TRUCKS} group by 1)
    select t.section_id, total_transactions, {_AVG_LANES} as avg_lanes,
           {sql_shown('total_transactions * coalesce(b, 1)', 'coalesce(a, 4)', 2)} as lane_utilization
    from t left join lanes on t.section_id = lanes.section_id""")
def a13(v):
    return A.lane_utilization(v.gtx, v.gantry)


_STATUS = "case when operation_status = '1' then '正常' else '异常' end"


@query("a14_station_status", f"""
    select toll_station_id, station_name, section_id, operation_status, {_STATUS} as status_text from v_station""")
def a14(v):
    return A.station_status(v.station)


@query("a14_station_status_summary", f"select {_STATUS} as status_text, count(*) as count from v_station group by 1")
def a14_summary(v):
    return A.station_status_summary(v.station)


@query("a15_stations_per_section", """
    select s.section_id, s.section_name, count(t.toll_station_id) as station_count
    from v_section s left join v_station t on s.section_id = t.section_id group by 1, 2""")
def a15(v):
    return A.stations_per_section(v.section, v.station)


@query("a16_truck_toll_total", f"""
    select {MONEY.format('toll_money')} as total_toll, count(*) as transaction_count
    from v_exit where vehicle_class in {TRUCKS}""")
def a16(v):
    return A.truck_toll_total(v.exit)


@query("a38_settlement", f"""
    select (select count(*) from v_entrance) as entrance_count, count(*) as exit_count,
           {MONEY.format('toll_money')} as total_toll_money, {MONEY.format('real_money')} as total_real_money,
           cast(sum(toll_money) - sum(real_money) as double) as discount_amount, {MEAN.format('real_money')} as average_fee
    from v_exit""")
def a38(v):
    return A.settlement(v.entrance, v.exit)


_MOMENTS = "m as (select avg(cast(toll_money as double)) as mean, stddev_pop(cast(toll_money as double)) as std from v_exit)"


@query("a39_fee_anomalies", f"""
    with {_MOMENTS}
    select exit_transaction_id as transaction_id, cast(toll_money as double) as fee,
           round(abs(cast(toll_money as double) - mean), 6) as deviation, '费用异常' as reason
    from v_exit, m where abs(cast(toll_money as double) - mean) > 1.5 * std""")
def a39(v):
    return six(A.fee_anomalies(v.exit, k=1.5), "deviation")


@query("a39_fee_anomaly_summary", f"""
    with {_MOMENTS}
    select count(*) as total_checked,
           count(case when abs(cast(toll_money as double) - mean) > 2.0 * std then 1 end) as anomaly_count,
           round(count(case when abs(cast(toll_money as double) - mean) > 2.0 * std then 1 end) * 100.0::double / count(*), 6) as anomaly_rate,
           round(max(mean), 6) as avg_fee, round(max(std), 6) as std_fee, round(max(std) * 2, 6) as threshold
    from v_exit, m""")
def a39_summary(v):
    return six(A.fee_anomaly_summary(v.exit), "anomaly_rate", "avg_fee", "std_fee", "threshold")


@query("a40_network_flow", f"""
    with f as (select section_id, section_name, count(*) as total_flow,
                      count(distinct {DAY.format('entrance_time')}) as days from v_entrance group by 1, 2)
    select section_id, section_name, total_flow, days, total_flow / days::double as daily_avg,
           cast(sum(total_flow) over () as bigint) as network_flow,
           section_id = first_value(section_id) over (order by total_flow desc, section_id) as is_busiest
    from f""")
def a40(v):
    return A.network_flow(v.entrance)
