"""Filters, joins, windows, ordering and set operations (F*, J*, W*, L*, S*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import day_label
from tollmill.operators import filters as R
from tollmill.operators import ordering as O
from tollmill.operators import privacy as P
from tollmill.operators import relational as J
from tollmill.operators.profiling import profile_categorical, value_frequency
from tollmill.operators.quality import accept, check_rules
from tollmill.plans.registry import PERIOD, TRUCKS, moment, query, sql_moment
from tollmill.functions.vehicles import time_period

SECTION = "G1000000005"


# --- filters -----------------------------------------------------------------


@query("f1_optional_filters", f"""
    select exit_transaction_id from v_exit where section_id = '{SECTION}' and vehicle_class = '11'""")
def f1(v):
    return R.where_opt(v.exit, section_id=SECTION, vehicle_class="11", pass_id=None, axis_count="").select(
        "exit_transaction_id"
    )


@query("f2_closed_range", """
    select entrance_transaction_id from v_entrance
    where entrance_time >= timestamp '1997-01-03' and entrance_time <= timestamp '1997-02-03'""")
def f2(v):
    return R.between_closed(v.entrance, "entrance_time", "1997-01-03", "1997-02-03").select("entrance_transaction_id")


@query("f3_half_open_range", """
    select entrance_transaction_id from v_entrance
    where entrance_time >= timestamp '1997-01-03' and entrance_time < timestamp '1997-02-03'""")
def f3(v):
    return R.between_half_open(v.entrance, "entrance_time", "1997-01-03", "1997-02-03").select("entrance_transaction_id")


@query("f4_trucks_only", f"select exit_transaction_id from v_exit where vehicle_class in {TRUCKS}")
def f4(v):
    return R.trucks_only(v.exit, "vehicle_class").select("exit_transaction_id")


@query("f5_usable_numeric", """
    select exit_transaction_id, total_weight, total_limit from v_exit
    where total_weight is not null and total_weight <> '' and total_weight <> '0'
      and total_limit is not null and total_limit <> '' and total_limit <> '0'""")
def f5(v):
    return R.usable_numeric(v.exit, "total_weight", "total_limit").select(
        "exit_transaction_id", "total_weight", "total_limit"
    )


@query("f6_non_blank", "select exit_transaction_id from v_exit where discount_type is not null and discount_type <> ''")
def f6(v):
    return v.exit.filter(R.non_blank("discount_type")).select("exit_transaction_id")


_ADHOC = """
    SELECT section_id, count(*) AS created_rows, max(total_limit) AS top_limit
    FROM toll_exits GROUP BY section_id ORDER BY section_id"""


@query("f11_safe_select", """
    select section_id, count(*) as created_rows, max(total_limit) as top_limit
    from v_exit group by section_id order by section_id limit 100""")
def f11(v):
    v.exit.createOrReplaceTempView("toll_exits")
    return R.safe_select(v.spark, _ADHOC, limit=100)


# --- projections -------------------------------------------------------------


@query("p1_derived_label", """
    select toll_station_id, case when operation_status = '1' then '正常' else '异常' end as status_text from v_station""")
def p1(v):
    label = F.when(F.col("operation_status") == "1", K.STATUS_NORMAL).otherwise(K.STATUS_ABNORMAL)
    return v.station.select("toll_station_id", label.alias("status_text"))


@query("p3_release_columns", """
    select vehicle_class, axis_count, total_limit, total_weight, cast(toll_money as double) as toll_money,
           cast(real_money as double) as real_money, discount_type from v_exit""")
def p3(v):
    return v.exit.select(*P.release_columns(v.exit))


# --- joins -------------------------------------------------------------------


@query("j1_section_lookup", """
    select e.entrance_transaction_id, s.section_name from v_entrance e join v_section s on e.section_id = s.section_id""")
def j1(v):
    return J.with_section_name(v.entrance.drop("section_name"), v.section).select("entrance_transaction_id", "section_name")


@query("j2_match_trips", """
    select x.exit_transaction_id, e.entrance_transaction_id
    from v_exit x join v_entrance e on x.pass_id = e.pass_id and x.section_id = e.section_id""")
def j2(v):
    out = v.exit.select("pass_id", "section_id", "exit_transaction_id")
    into = v.entrance.select("pass_id", "section_id", "entrance_transaction_id")
    return J.match_trips(out, into).select("exit_transaction_id", "entrance_transaction_id")


@query("j3_gantry_lookup", """
    select g.section_id, count(*) as cnt from v_gtx x join v_gantry g on x.gantry_id = g.gantry_id group by 1""")
def j3(v):
    return J.with_gantry(v.gtx, v.gantry).groupBy("section_id").agg(F.count(F.lit(1)).alias("cnt"))


@query("j4_left_join_aggregate", """
    select s.section_id, l.avg_lanes from v_section s left join (
      select section_id, avg(cast(try_cast(lane_count as decimal(10,0)) as double)) as avg_lanes from v_gantry group by 1) l
    on s.section_id = l.section_id""")
def j4(v):
    from tollmill.operators.analytics import section_lanes

    lanes = section_lanes(v.gantry).select("section_id", (F.col("lanes") / F.nullif("gantries", F.lit(0))).alias("avg_lanes"))
    return v.section.select("section_id").join(lanes, "section_id", "left")


@query("j5_children_count", """
    select s.section_id, s.section_name, count(g.gantry_id) as gantries
    from v_section s left join v_gantry g on s.section_id = g.section_id group by 1, 2""")
def j5(v):
    return J.children_count(v.section, v.gantry.select("section_id"), "section_id", "gantries")


_MOVED = """m as (select ok, gantry_id, transaction_time, entrance_time, pay_fee, total_weight,
                  case when ok % 5 = 0 then 'X0000000000' else section_id end as section_id,
                  case when ok % 5 = 0 then 'nowhere' else section_name end as section_name,
                  case when ok % 11 = 0 then 'GT-none' else gantry_id end as g from v_gtx)"""


@query("j6_repair_section", f"""
    with {_MOVED}
    select m.ok, m.g as gantry_id,
           case when d.gantry_id is not null and m.section_id is distinct from d.section_id then d.section_id else m.section_id end as section_id,
           case when d.gantry_id is not null and m.section_id is distinct from d.section_id then d.section_name else m.section_name end as section_name,
           m.g <> '' and d.gantry_id is null as unknown
    from m left join v_gantry d on m.g = d.gantry_id""")
def j6(v):
    moved = v.gtx_named.select(
        "ok", F.when(F.col("ok") % 11 == 0, "GT-none").otherwise(F.col("gantry_id")).alias("gantry_id"),
        F.when(F.col("ok") % 5 == 0, "X0000000000").otherwise(F.col("section_id")).alias("section_id"),
        F.when(F.col("ok") % 5 == 0, "nowhere").otherwise(F.col("section_name")).alias("section_name"),
    )
    return J.repair_section(moved, v.gantry_map).withColumnRenamed("_gantry_unknown", "unknown")


@query("j7_fallback_marginal", """
    with learned as (select * from v_gtx where vehicle_type <> '22'),
    c as (select vehicle_type, axle_count, count(*) / sum(count(*)) over (partition by vehicle_type)::double as prob from learned group by 1, 2),
    m as (select axle_count, count(*) / sum(count(*)) over ()::double as prob from learned group by 1),
    k as (select distinct vehicle_type, axle_count from v_gtx)
    select k.vehicle_type, k.axle_count, coalesce(c.prob, m.prob) as prob
    from k left join c on k.vehicle_type = c.vehicle_type and k.axle_count = c.axle_count
           left join m on k.axle_count = m.axle_count""")
def j7(v):
    learned = v.gtx.filter(F.col("vehicle_type") != "22")
    pairs = learned.groupBy("vehicle_type", "axle_count").agg(F.count(F.lit(1)).alias("cnt"))
    singles = learned.groupBy("axle_count").agg(F.count(F.lit(1)).alias("cnt"))
    asked = v.gtx.select("vehicle_type", "axle_count").distinct()
    return J.with_fallback(
        asked, O.with_share(pairs, over="vehicle_type", share="prob"), O.with_share(singles, share="prob"),
        "vehicle_type", "axle_count",
    )


@query("j9_align_distributions", """
    with a as (select axle_count as value, count(*) / sum(count(*)) over ()::double as p from v_gtx where ok % 2 = 0 group by 1),
         b as (select axle_count as value, count(*) / sum(count(*)) over ()::double as q from v_gtx where ok % 2 = 1 group by 1)
    select 'axle_count' as field, coalesce(a.value, b.value) as value, coalesce(p, 0) as p, coalesce(q, 0) as q
    from a full join b on a.value = b.value""")
def j9(v):
    a = profile_categorical(v.even, ["axle_count"])
    b = profile_categorical(v.odd, ["axle_count"])
    return J.align_distributions(a, b)


_DATES = "d as (select distinct section_id, strftime(transaction_time, '%Y-%m-%d') as date from v_gtx where ok % 10 <> 0)"


@query("j10_section_date_check", f"""
    with {_DATES}
    select x.gantry_transaction_id, x.section_id, strftime(transaction_time, '%Y-%m-%d') as date
    from v_gtx x where section_id in (select section_id from d)
      and not exists (select 1 from d where d.section_id = x.section_id and d.date = strftime(x.transaction_time, '%Y-%m-%d'))""")
def j10(v):
    from tollmill.operators.profiling import section_dates
    from tollmill.operators.quality import section_date_errors

    dates = section_dates(v.gtx.filter("ok % 10 <> 0"))
    wrong = section_date_errors(v.gtx, dates)
    return wrong.select(
        "gantry_transaction_id", "section_id", day_label(F.col("transaction_time")).alias("date")
    )


@query("j11_nearest_centroid", """
    with c as (select section_id as label, avg(toll_money::double)::bigint::double as x, avg(hour(exit_time))::bigint::double as y from v_exit group by 1),
    p as (select exit_transaction_id, toll_money::double as x, hour(exit_time)::double as y from v_exit),
    r as (select exit_transaction_id, label, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) as distance,
                 row_number() over (partition by exit_transaction_id order by (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), label) as rn
          from p, c)
    select exit_transaction_id, label as nearest_label, distance from r where rn = 1""")
def j11(v):
    money, hour = F.col("toll_money").cast("double"), F.hour("exit_time").cast("double")
    centroids = v.exit.groupBy(F.col("section_id").alias("label")).agg(
        F.round(F.avg(money)).alias("x"), F.round(F.avg(hour)).alias("y")
    )
    points = v.exit.select("exit_transaction_id", money.alias("x"), hour.alias("y"))
    return P.nearest_centroid(points, centroids, ["x", "y"]).select("exit_transaction_id", "nearest_label", "distance")


_EN_TAGS = {"weather": ["the", "wind"], "roads": ["rue", "street", "straße"], "rules": ["und", "must"]}


@query("j12_match_tags", """
    with t as (select unnest(['weather','weather','roads','roads','roads','rules','rules']) as tag,
                      unnest(['the','wind','rue','street','straße','und','must']) as word),
    hits as (select distinct doc_id, tag from documents, t where contains(lower(text), word))
    select doc_id, tag from hits
    union all
    select doc_id, unnest(['hourly-flow','avg-travel-time','congestion-index']) from documents
    where doc_id not in (select doc_id from hits)""")
def j12(v):
    return J.match_tags(v.table("documents").select("doc_id", "text"), "text", _EN_TAGS).select("doc_id", "tag")


_SENTENCE = "concat('flow of ', station_name, ' near ', case when length(station_name) % 2 = 0 then section_name else 'nowhere' end, case when toll_station_id like '%7' then ' and NATION_3' else '' end)"


@query("j13_resolve_section", f"""
    with t as (select toll_station_id, {_SENTENCE} as sentence from v_station join v_section using (section_id)),
    r as (select toll_station_id, min(s.section_id) as resolved_section_id
          from t join v_section s on contains(t.sentence, s.section_name) group by 1)
    select t.toll_station_id, r.resolved_section_id from t left join r on t.toll_station_id = r.toll_station_id""")
def j13(v):
    texts = v.station.join(v.section, "section_id").select("toll_station_id", F.expr(_SENTENCE).alias("sentence"))
    return J.resolve_section(texts, v.section, "sentence").select("toll_station_id", "resolved_section_id")


# --- windows -----------------------------------------------------------------


@query("w1_top_n_per_group", """
    with c as (select vehicle_type, gantry_id, count(*) as cnt from v_gtx group by 1, 2),
         r as (select *, row_number() over (partition by vehicle_type order by cnt desc, gantry_id) as rn from c)
    select vehicle_type, gantry_id, cnt from r where rn <= 3""")
def w1(v):
    counts = v.gtx.groupBy("vehicle_type", "gantry_id").agg(F.count(F.lit(1)).alias("cnt"))
    return O.top_n_per_group(counts, "vehicle_type", [F.desc("cnt"), F.asc("gantry_id")], 3)


@query("w2_share", """
    select section_id, vehicle_type, count(*) as cnt,
           count(*) / sum(count(*)) over (partition by section_id)::double as share
    from v_gtx group by 1, 2""")
def w2(v):
    counts = v.gtx.groupBy("section_id", "vehicle_type").agg(F.count(F.lit(1)).alias("cnt"))
    return O.with_share(counts, over="section_id")


@query("w3_cumulative_weight", """
    with c as (select gantry_id as value, count(*) as cnt from v_gtx group by 1)
    select value, cnt, cast(sum(cnt) over (order by value rows unbounded preceding) as bigint) as cumulative,
           sum(cnt) over (order by value rows unbounded preceding) / sum(cnt) over ()::double as upper
    from c""")
def w3(v):
    counts = v.gtx.groupBy(F.col("gantry_id").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return O.cumulative_weight(counts, ["value"], "cnt")


@query("w4_positional_chunks", """
    select exit_transaction_id, cast(floor((row_number() over (order by exit_time, exit_transaction_id) - 1) / 50) as bigint) as chunk
    from v_exit""")
def w4(v):
    rows = v.exit.select("exit_time", "exit_transaction_id")
    return O.chunk_of(rows, ["exit_time", "exit_transaction_id"], 50).select("exit_transaction_id", "chunk")


@query("w5_mode_per_group", """
    with c as (select section_id, axis_count, count(*) as cnt from v_exit where axis_count is not null group by 1, 2),
         r as (select *, row_number() over (partition by section_id order by cnt desc, axis_count) as rn from c)
    select section_id, axis_count, cnt from r where rn = 1""")
def w5(v):
    return O.mode_per_group(v.exit, "section_id", "axis_count")


# --- ordering ----------------------------------------------------------------


@query("l1_latest", f"""
    select entrance_transaction_id, {sql_moment('entrance_time')} as entrance_time from v_entrance
    order by v_entrance.entrance_time desc, entrance_transaction_id limit 200""")
def l1(v):
    return O.latest(v.entrance, "entrance_time", 200, tie="entrance_transaction_id").select(
        "entrance_transaction_id", moment("entrance_time").alias("entrance_time")
    )


@query("l2_limit_offset", """
    select entrance_transaction_id, (select count(*) from v_entrance) as total from v_entrance
    order by entrance_time desc, entrance_transaction_id limit 100 offset 300""")
def l2(v):
    total = v.entrance.agg(F.count(F.lit(1))).scalar()
    rows = O.latest(v.entrance, "entrance_time", 100, 300, "entrance_transaction_id")
    return rows.select("entrance_transaction_id", total.alias("total"))


@query("l4_top_k", "select gantry_id, count(*) as cnt from v_gtx group by 1 order by 2 desc, 1 limit 10")
def l4(v):
    return O.top_k(v.gtx, "gantry_id", 10)


@query("l5_multi_key_sort", f"""
    select section_id, {PERIOD.format('entrance_time')} as period, count(*) as cnt from v_entrance group by 1, 2 order by 1, 2""")
def l5(v):
    counts = v.entrance.groupBy("section_id", time_period(F.col("entrance_time")).alias("period"))
    return counts.agg(F.count(F.lit(1)).alias("cnt")).orderBy("section_id", "period")


@query("l6_top_fraction", """
    with r as (select *, row_number() over (order by real_money desc, exit_transaction_id) as rn, count(*) over () as n
               from v_exit)
    select exit_transaction_id from r where rn <= least(n // 5, 50)""")
def l6(v):
    best = O.top_fraction(v.exit, [F.desc("real_money"), F.asc("exit_transaction_id")], cap=50)
    return best.select("exit_transaction_id")


# --- set operations ----------------------------------------------------------


@query("s2_append_rows", """
    select pass_id, vehicle_class, 'in' as side from v_entrance
    union all select pass_id, vehicle_class, 'out' from v_exit""")
def s2(v):
    into = v.entrance.select("pass_id", "vehicle_class", F.lit("in").alias("side"))
    return J.append_rows(into, v.exit.select("pass_id", "vehicle_class", F.lit("out").alias("side")))


@query("s3_shared_values", "select pass_id from v_entrance intersect select pass_id from v_exit")
def s3(v):
    return J.shared_values(v.entrance, v.exit, "pass_id")


@query("s4_all_values", """
    select strftime(entrance_time, '%Y-%m-%d') as date from v_entrance
    union select strftime(exit_time, '%Y-%m-%d') from v_exit""")
def s4(v):
    a = v.entrance.select(day_label(F.col("entrance_time")).alias("date"))
    return J.all_values(a, v.exit.select(day_label(F.col("exit_time")).alias("date")), "date")


@query("s5_partition_pass_fail", """
    select case when coalesce(try_cast(total_weight as double) <= 15000, false) then 'pass' else 'fail' end as side, count(*) as cnt
    from v_exit group by 1""")
def s5(v):
    ok, bad = J.partition_pass_fail(v.exit, F.col("total_weight").try_cast("double") <= 15000)
    both = ok.select(F.lit("pass").alias("side")).unionByName(bad.select(F.lit("fail").alias("side")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("cnt"))


@query("s6_distinct_values", "select distinct section_id, vehicle_type from v_gtx")
def s6(v):
    return v.gtx.select("section_id", "vehicle_type").distinct()
