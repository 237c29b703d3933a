"""Rule checks, repair, weights, corrections and exemplars (Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.operators import exemplars as X
from tollmill.operators import quality as Q
from tollmill.operators.profiling import profile_numeric, section_dates
from tollmill.operators.relational import append_rows
from tollmill.plans.registry import limit_of, moment, query, six, sql_key, sql_moment, whole
from tollmill.session import scratch_path

# the fixture has no row with an unreadable fee or code, so some are made so
_DIRTY = {
    "vehicle_type": "case when ok % 97 = 0 then 'bus' else vehicle_type end",
    "pay_fee": "case when ok % 89 = 0 then null else pay_fee end",
    "section_id": "case when ok % 71 = 0 then 'X0000000000' else section_id end",
}
_COLUMNS = [
    "gantry_transaction_id", "gantry_id", "section_id", "section_name", "vehicle_type", "transaction_time", "entrance_time",
    "pay_fee", "discount_fee", "fee_mileage", "axle_count", "total_weight", "media_type", "pass_state", "ok",
]
_SELECT = ", ".join(f"{_DIRTY[c]} as {c}" if c in _DIRTY else c for c in _COLUMNS)
D = f"d as (select {_SELECT} from v_gtx)"


def dirty(v):
    return v.gtx_named.selectExpr(*[f"{_DIRTY[c]} as {c}" if c in _DIRTY else c for c in _COLUMNS])


KIND = whole("vehicle_type")
WEIGHT = whole("total_weight")
FREIGHT = f"({KIND} between 11 and 16 or {KIND} between 21 and 26)"
HOURS = "(epoch_us(transaction_time) - epoch_us(entrance_time)) / 1000000.0::double / 3600.0::double"


def time_issue(hours: int = 6) -> str:
    return (
        f"case when entrance_time is null or transaction_time is null then '时间格式错误' "
        f"when entrance_time >= transaction_time then '时间错误' when {HOURS} > {hours} then '时间异常' end"
    )


FEE_ISSUE = """case when pay_fee is null or discount_fee is null then '费用字段格式错误'
                    when discount_fee > pay_fee or pay_fee < 0 then '费用错误' end"""
VEHICLE_ISSUE = f"""case when {KIND} is null then '车型格式错误'
                         when {KIND} between 1 and 4 and axle_count is distinct from '2' then '车辆逻辑错误'
                         when {FREIGHT} and {WEIGHT} > {limit_of('axle_count')} * 1.5::double then '重量异常' end"""
MISSING_ISSUE = """case when gantry_transaction_id is null or gantry_transaction_id = '' or vehicle_type is null or vehicle_type = ''
                           or transaction_time is null or pay_fee is null or pay_fee = 0 then '缺失必要字段' end"""
ISSUES = f"""concat_ws('|', {time_issue()}, {FEE_ISSUE}, {VEHICLE_ISSUE}, {MISSING_ISSUE})"""
COUNT = f"""(({time_issue()}) is not null)::int + (({FEE_ISSUE}) is not null)::int + (({VEHICLE_ISSUE}) is not null)::int
            + (({MISSING_ISSUE}) is not null)::int"""
SCORED = f"{D}, s as (select *, {ISSUES} as issues, {COUNT} as n_issues from d)"


@query("q1_check_rules", f"""
    with {SCORED}
    select gantry_transaction_id, ok, issues, n_issues, greatest(0, 1 - n_issues * 0.2::double) as score from s""")
def q1(v):
    return Q.check_rules(dirty(v)).select(
        "gantry_transaction_id", "ok", F.concat_ws("|", "issues").alias("issues"), "n_issues", "score"
    )


def _one_check(name: str, sql: str, build) -> None:
    @query(name, f"with {D} select {sql} as issue, count(*) as cnt from d group by 1")
    def run(v):
        rows = dirty(v)
        return rows.groupBy(build(rows).alias("issue")).agg(F.count(F.lit(1)).alias("cnt"))


_one_check("q1a_time_check", time_issue(), Q.time_issue)
_one_check("q1b_fee_check", FEE_ISSUE, Q.fee_issue)
_one_check("q1c_vehicle_check", VEHICLE_ISSUE, Q.vehicle_issue)
_one_check("q1d_completeness_check", MISSING_ISSUE, Q.missing_issue)


@query("q2_accept", f"with {SCORED} select gantry_transaction_id, ok, n_issues from s where n_issues <= 2")
def q2(v):
    return Q.accept(Q.check_rules(dirty(v))).select("gantry_transaction_id", "ok", "n_issues")


@query("q3_issue_top", f"""
    with {SCORED}, e as (select unnest(string_split(issues, '|')) as issue from s where issues <> '')
    select issue, count(*) as cnt from e group by 1 order by 2 desc, 1 limit 5""")
def q3(v):
    return Q.issue_top(Q.check_rules(dirty(v)))


LEARNED = "k as (select distinct section_id, strftime(transaction_time, '%Y-%m-%d') as date from v_gtx where ok % 10 <> 0)"
DATE_ERROR = """(section_id in (select section_id from k) and not exists
    (select 1 from k where k.section_id = {0}.section_id and k.date = strftime({0}.transaction_time, '%Y-%m-%d')))"""


def learned_dates(v):
    return section_dates(v.gtx.filter("ok % 10 <> 0"))


@query("q4_section_date_errors", f"""
    with {D}, {LEARNED} select gantry_transaction_id, ok, section_id from d where {DATE_ERROR.format('d')}""")
def q4(v):
    return Q.section_date_errors(dirty(v), learned_dates(v)).select("gantry_transaction_id", "ok", "section_id")


# the moved entrance is a hash-derived moment: the span is checked, not the moment
_REPAIRED = f"""r as (select d.ok, d.gantry_transaction_id, d.gantry_id, d.vehicle_type, d.pay_fee, d.fee_mileage, d.total_weight,
      d.media_type, d.pass_state, d.transaction_time, d.entrance_time as old_entrance,
      case when d.entrance_time >= d.transaction_time then d.transaction_time - interval 1 hour else d.entrance_time end as entrance_time,
      case when discount_fee > pay_fee then cast(trunc(pay_fee * 0.05::double) as int) else discount_fee end as discount_fee,
      case when {KIND} between 1 and 4 then '2' else axle_count end as axle_count,
      case when d.section_id is distinct from g.section_id then g.section_id else d.section_id end as section_id,
      case when d.section_id is distinct from g.section_id then g.section_name else d.section_name end as section_name
   from d join v_gantry g on d.gantry_id = g.gantry_id)"""


@query("q5_repair", f"""
    with {D}, {_REPAIRED}
    select gantry_transaction_id, ok, discount_fee, axle_count, section_id, section_name,
           coalesce(old_entrance >= transaction_time, false) as moved, coalesce(entrance_time < transaction_time, false) as in_order
    from r""")
def q5(v):
    rows = dirty(v).withColumn("_old", F.col("entrance_time"))
    fixed = Q.repair(rows, v.gantry_map)
    seconds = F.timestamp_diff("SECOND", F.col("entrance_time"), F.col("transaction_time"))
    moved = F.coalesce(F.col("_old") >= F.col("transaction_time"), F.lit(False))
    right = F.when(moved, seconds.between(1800, 7200)).otherwise(F.col("entrance_time") < F.col("transaction_time"))
    return fixed.select(
        "gantry_transaction_id", "ok", "discount_fee", "axle_count", "section_id", "section_name",
        moved.alias("moved"), F.coalesce(right, F.lit(False)).alias("in_order"),
    )


_FILLED = f"""f as (select * replace (
      case when media_type = '1' and discount_fee = 0 then cast(trunc(pay_fee * 0.05::double) as int) else discount_fee end as discount_fee,
      case when {FREIGHT} and {WEIGHT} > {limit_of('axle_count')} then '2' else pass_state end as pass_state) from {{0}})"""


@query("q6_fill_knowledge", f"""
    with {D}, {_FILLED.format('d')} select gantry_transaction_id, ok, cast(discount_fee as double) as discount_fee, pass_state from f""")
def q6(v):
    return Q.fill_knowledge(dirty(v), media_text=True).select(
        "gantry_transaction_id", "ok", F.col("discount_fee").cast("double").alias("discount_fee"), "pass_state"
    )


@query("q7_recover", f"""
    with {D}, b as (select *, {COUNT} as n_before from d), {_REPAIRED.replace('from d join', 'from b d join').replace('d.ok,', 'd.ok, d.n_before,')},
    {_FILLED.format('r')}
    select gantry_transaction_id, ok, n_before > 2 as recovered, {COUNT} as n_issues, cast(discount_fee as double) as discount_fee, pass_state
    from f where n_before <= 2 or {COUNT} <= 2""")
def q7(v):
    kept = Q.recover(dirty(v), v.gantry_map, media_text=True)
    return kept.select(
        "gantry_transaction_id", "ok", F.col("_recovered").alias("recovered"), "n_issues",
        F.col("discount_fee").cast("double").alias("discount_fee"), "pass_state",
    )


_MIXED = ["gantry_transaction_id", "vehicle_type", "pay_fee"]


def _drawn(cols: list[str], half: int, n: int) -> str:
    return f"""(select *, row_number() over (order by {sql_key(42, *cols)}, {', '.join(cols)}) as rn from v_gtx where ok % 2 = {half}) where rn <= {n}"""


@query("s1_mix_sources", f"""
    select {', '.join(_MIXED)}, 'a' as _source, null::bigint as ok from {_drawn(_MIXED, 0, 1400)}
    union all select {', '.join(_MIXED)}, 'b', ok from {_drawn([*_MIXED, 'ok'], 1, 600)}""")
def s1(v):
    from tollmill.operators.relational import mix

    return mix(v.even.select(*_MIXED), v.odd.select(*_MIXED, "ok"), 2000, 0.7)


@query("s2_append_recovered", f"""
    with {SCORED} select gantry_transaction_id, ok, 'passed' as origin from s where n_issues <= 1
    union all select gantry_transaction_id, ok, 'recovered' from s where n_issues = 2""")
def s2(v):
    # stored, as both parts read it: a filter on the number itself would go through all rules again, and twice
    path = scratch_path(v.spark, "scored")
    Q.check_rules(dirty(v)).select("gantry_transaction_id", "ok", "n_issues").write.parquet(path)
    scored = v.spark.read.parquet(path)
    passed = scored.filter("n_issues <= 1").withColumn("origin", F.lit("passed"))
    return append_rows(passed, scored.filter("n_issues = 2").withColumn("origin", F.lit("recovered"))).drop("n_issues")


_TRUCK = f"coalesce({FREIGHT}, false)"
_WEIGHT = """least(3.0::double, case when truck then 0.6::double else 0.4::double end
                   / (case when truck then trucks else total - trucks end / total::double))"""


@query("q8_static_weights", f"""
    with {D}, c as (select *, {_TRUCK} as truck from d),
    t as (select *, count(case when truck then 1 end) over () as trucks, count(*) over () as total from c)
    select gantry_transaction_id, ok, {_WEIGHT} as weight from t""")
def q8(v):
    return Q.static_weights(dirty(v)).select("gantry_transaction_id", "ok", F.col("_quality_weight").alias("weight"))


_ORDER = ["transaction_time", "gantry_transaction_id", *[c for c in _COLUMNS if c not in ("transaction_time", "gantry_transaction_id")]]
_SQL_ORDER = ", ".join(f"{c} asc nulls first" for c in _ORDER)


def _round(w: str) -> str:
    return f"least(3.0::double, greatest(0.1::double, {w} * (case when n_issues <= 1 then 1.1::double when n_issues >= 3 then 0.9::double else 1.0::double end)))"


_FIVE = "w0"
_STEPS = []
for _i in range(5):
    _STEPS.append(f"s{_i + 1} as (select *, {_round(f'w{_i}')} as w{_i + 1} from s{_i})")
_REWEIGHTED = f"""{D}, c as (select *, {COUNT} as n_issues, {_TRUCK} as truck,
      row_number() over (order by {_SQL_ORDER}) as rn, count(*) over () as n from d),
    h as (select *, count(case when truck then 1 end) over () as trucks, count(*) over () as total from c where rn <= floor(n * 0.8::double)),
    s0 as (select *, {_WEIGHT} as w0 from h), {', '.join(_STEPS)},
    w as (select gantry_transaction_id, ok, w5 as weight from s5
          union all select gantry_transaction_id, ok, 1.0::double from c where rn > floor(n * 0.8::double))"""


@query("q9_iterative_weights", f"with {_REWEIGHTED} select gantry_transaction_id, ok, round(weight, 6) as weight from w")
def q9(v):
    weighted = Q.iterative_weights(dirty(v), order=_ORDER)
    return six(weighted.select("gantry_transaction_id", "ok", F.col("_quality_weight").alias("weight")), "weight")


@query("q10_quality_tiers", f"""
    with {_REWEIGHTED}, t as (select case when weight >= 1.2 then 'high' when weight >= 0.8 then 'medium' else 'low' end as tier from w)
    select tier, count(*) as cnt, count(*) * 100.0::double / sum(count(*)) over () as percentage from t group by 1""")
def q10(v):
    return Q.tier_summary(Q.iterative_weights(dirty(v), order=_ORDER))


@query("l7_by_weight", f"""
    with {_REWEIGHTED} select gantry_transaction_id, ok, round(weight, 6) as weight from w order by w.weight desc""")
def l7(v):
    best = Q.by_weight(Q.iterative_weights(dirty(v), order=_ORDER))
    return six(best.select("gantry_transaction_id", "ok", F.col("_quality_weight").alias("weight")), "weight")


_EXPECTED = f"""case when {WEIGHT} is null then null when {KIND} between 1 and 4 then '2'
                     when {KIND} = 13 then '3' when {KIND} = 14 then '4' when {KIND} = 15 then '5' when {KIND} = 16 then '6'
                     when {KIND} in (11, 12) then '2' end"""


@query("q11_verify_vehicle", f"""
    with {D}, e as (select *, {_EXPECTED} as expected, coalesce({KIND} between 1 and 4 and not {WEIGHT} between 2000 and 5000, false) as heavy from d)
    select gantry_transaction_id, ok, coalesce(expected, axle_count) as axle_count,
           case when heavy then 'total_weight' when expected is not null and axle_count is distinct from expected then 'axle_count' end as fixed,
           true as weight_fits
    from e""")
def q11(v):
    out = Q.verify_vehicle(dirty(v).withColumn("_old", F.col("total_weight")))
    replaced = F.col("_auxiliary_fixed").eqNullSafe(F.lit("total_weight"))
    fits = F.when(replaced, F.col("total_weight").cast("int").between(2500, 4500)).otherwise(
        F.col("total_weight") == F.col("_old")
    )
    return out.select("gantry_transaction_id", "ok", "axle_count", F.col("_auxiliary_fixed").alias("fixed"), fits.alias("weight_fits"))


def _z(c: str, num: str) -> tuple[str, str]:
    stat = f"avg({num}) as {c}_m, stddev_samp({num}) as {c}_d"
    far = f"coalesce(abs({num} - {c}_m) / ({c}_d + 1e-10::double) > 1.5, false)"
    return stat, far


_ZF = {"pay_fee": "cast(pay_fee as double)", "fee_mileage": "try_cast(fee_mileage as double)", "total_weight": "try_cast(total_weight as double)"}
_ZS = {c: _z(c, n) for c, n in _ZF.items()}


@query("q12_zscore_fix", f"""
    with {D}, z as (select {', '.join(s for s, _ in _ZS.values())} from d where ok % 2 = 0)
    select gantry_transaction_id, ok,
           case when {_ZS['pay_fee'][1]} then trunc(pay_fee_m) else cast(pay_fee as double) end as pay_fee,
           case when {_ZS['fee_mileage'][1]} then cast(cast(trunc(fee_mileage_m) as bigint) as varchar) else fee_mileage end as fee_mileage,
           case when {_ZS['total_weight'][1]} then cast(cast(trunc(total_weight_m) as bigint) as varchar) else total_weight end as total_weight,
           ({_ZS['pay_fee'][1]})::int + ({_ZS['fee_mileage'][1]})::int + ({_ZS['total_weight'][1]})::int as n_corrections
    from d, z where ok % 2 = 1""")
def q12(v):
    rows = dirty(v)
    fixed = Q.zscore_fix(rows.filter("ok % 2 = 1"), rows.filter("ok % 2 = 0"), k=1.5)
    return fixed.select(
        "gantry_transaction_id", "ok", F.col("pay_fee").cast("double").alias("pay_fee"), "fee_mileage", "total_weight", F.size("_corrections").alias("n_corrections")
    )


@query("q13_reference_stats", " union all ".join(f"""
    select '{c}' as field, count(try_cast({c} as double)) as n, min(try_cast({c} as double)) as min, max(try_cast({c} as double)) as max,
           round(avg(try_cast({c} as double)), 6) as mean, round(stddev_samp(try_cast({c} as double)), 6) as std,
           quantile_cont(try_cast({c} as double), 0.25) as p25, quantile_cont(try_cast({c} as double), 0.5) as p50,
           quantile_cont(try_cast({c} as double), 0.75) as p75
    from v_gtx where ok % 2 = 0""" for c in ("pay_fee", "fee_mileage", "total_weight")))
def q13(v):
    stats = profile_numeric(v.even, ["pay_fee", "fee_mileage", "total_weight"], sample_std=True)
    return six(stats, "mean", "std")


_COEF = """case vehicle_type when '11' then 1.5::double when '12' then 1.5::double when '13' then 2.0::double when '14' then 2.5::double
           when '15' then 3.0::double when '16' then 3.5::double else 1.0::double end"""


@query("q14_fee_deviation", f"""
    with {D}, e as (select *, cast(trunc({whole('fee_mileage')} / 1000.0::double * 0.45::double * {_COEF} * 100.0::double) as bigint) as expected from d)
    select gantry_transaction_id, ok, coalesce(pay_fee > 0 and abs(pay_fee - expected) / nullif(expected, 0)::double > 0.5, false) as fee_anomaly,
           case when pay_fee > 0 and abs(pay_fee - expected) / nullif(expected, 0)::double > 0.5 then cast(expected as double) end as expected_fee
    from e""")
def q14(v):
    return Q.fee_deviation(dirty(v)).select(
        "gantry_transaction_id", "ok", F.col("_fee_anomaly").alias("fee_anomaly"), F.col("_expected_fee").cast("double").alias("expected_fee")
    )


_OLD = f"""(entrance_time is null or transaction_time is null or entrance_time >= transaction_time or {HOURS} > 4)::int
          + coalesce(discount_fee > pay_fee, false)::int
          + coalesce(vehicle_type = '2' and {WEIGHT} > {limit_of('axle_count')} * 1.5::double, false)::int"""
_POINTS = f"""greatest(0, 10 - 2 * ({_OLD})) + 5 * (coalesce(vehicle_type = '1' and axle_count = '2', false)::int + coalesce(pay_fee > 0, false)::int)"""


@query("q15_legacy_quality", f"""
    with {D}, a as (select *, {_POINTS} as first from d),
    b as (select * replace (case when first < 12 and discount_fee > pay_fee then cast(trunc(pay_fee * 0.05::double) as int) else discount_fee end as discount_fee,
                            case when first < 12 and entrance_time >= transaction_time then transaction_time - interval 90 minute else entrance_time end as entrance_time) from a),
    c as (select *, {_POINTS} as second from b)
    select gantry_transaction_id, ok, case when first < 12 then second else first end / 20.0::double as overall,
           first < 12 as repaired, first >= 12 or second >= 10 as kept from c""")
def q15(v):
    return Q.legacy_quality(dirty(v)).select("gantry_transaction_id", "ok", "overall", "repaired", "kept")


@query("q16_valid_only", f"""
    with {D} select gantry_transaction_id, ok from d
    where not coalesce(entrance_time >= transaction_time, false) and not coalesce(discount_fee > pay_fee, false)""")
def q16(v):
    return Q.valid_only(dirty(v)).select("gantry_transaction_id", "ok")


_EXP_FEE = f"""cast(trunc({whole('fee_mileage')} / 1000.0::double * (case vehicle_type when '1' then 0.45::double when '2' then 0.75::double
    when '3' then 1.05::double when '4' then 1.25::double else {K.FREIGHT_RATE!r}::double end) * 100.0::double) as bigint)"""
_ABSENT = " + ".join(
    f"({c} is null or {c} = '')::int" for c in ("gantry_id", "vehicle_type", "fee_mileage")
) + " + (transaction_time is null)::int + (entrance_time is null)::int + (pay_fee is null or pay_fee = 0)::int"
_READ = f"(pay_fee is not null and discount_fee is not null and {whole('fee_mileage')} is not null)"
_QUALITY = f"""(0.3::double * (1.0::double - ({_ABSENT}) / 6.0::double) + 0.7::double)
    * (case when entrance_time is null or transaction_time is null then 0.5::double when entrance_time >= transaction_time then 0.3::double
            when {HOURS} between 0.5 and 6 then 1.0::double else 0.8::double end)
    * (case when not {_READ} then 0.6::double
            when pay_fee > 0 and {_EXP_FEE} > 0 and pay_fee / nullif({_EXP_FEE}, 0)::double between 0.7::double and 1.3::double then 1.0::double
            else 0.7::double end)
    * (case when {_READ} and discount_fee > pay_fee then 0.4::double else 1.0::double end)
    * (case when {KIND} is null then 0.7::double when {KIND} between 1 and 4 and axle_count is distinct from '2' then 0.6::double else 1.0::double end)"""
_OVER = f"coalesce({WEIGHT} > {limit_of('axle_count')}, false)"
_SIMILAR = f"""least(1.0::double, (case when {KIND} is not null and {_TRUCK} then 0.4::double else 0.0::double end)
    + (case when {_OVER} then 0.3::double else 0.0::double end)
    + (case when hour(transaction_time) between 7 and 8 then 0.3::double else 0.0::double end))"""
_DIFFICULT = f"""least(1.0::double, 0.5::double
    + (case when {KIND} between 11 and 16 then 0.15::double when {KIND} between 21 and 26 then 0.25::double else 0.0::double end)
    + (case when {WEIGHT} / {limit_of('axle_count')}::double between 0.85::double and 1.15::double then 0.2::double else 0.0::double end)
    + (case when pass_state = '2' then 0.15::double else 0.0::double end) + 0.1::double)"""
CONDITION = {"vehicle_type": K.TRUCK, "scenario": K.OVERLOADED, "time_period": K.MORNING_PEAK}


@query("q17_exemplar_quality", f"with {D} select gantry_transaction_id, ok, round({_QUALITY}, 6) as quality from d")
def q17(v):
    return six(X.exemplar_quality(dirty(v)).select("gantry_transaction_id", "ok", "quality"), "quality")


@query("q18_similarity", f"with {D} select gantry_transaction_id, ok, round({_SIMILAR}, 6) as similarity from d")
def q18(v):
    return six(X.similarity(dirty(v), CONDITION).select("gantry_transaction_id", "ok", "similarity"), "similarity")


@query("q19_difficulty", f"with {D} select gantry_transaction_id, ok, round({_DIFFICULT}, 6) as difficulty from d")
def q19(v):
    return six(X.difficulty(dirty(v)).select("gantry_transaction_id", "ok", "difficulty"), "difficulty")


_RANKED = f"""r as (select *, {_QUALITY} * 0.4::double + {_SIMILAR} * 0.4::double + {_DIFFICULT} * 0.2::double as score,
                   {KIND} as kind, {whole('fee_mileage')} as mileage, hour(transaction_time) as hr from d where {_QUALITY} >= 0.5)"""


@query("q20_select_exemplars", f"""
    with {D}, {_RANKED}, p as (select *, row_number() over (order by score desc, {_SQL_ORDER}) as pos from r),
    pool as (select * from p where pos <= 4), a as (select * from pool where pos = 1),
    g as (select b.*, (coalesce(abs(a.kind - b.kind) / 26.0::double, 0) + coalesce(least(abs(a.mileage - b.mileage) / 200000.0::double, 1), 0)
                       + coalesce(least(abs(a.hr - b.hr) / 24.0::double, 1), 0)) / 3.0::double as gap
          from pool b, a where b.pos > 1),
    f as (select *, row_number() over (order by gap desc, pos) as pick from g)
    select 1 as pick, gantry_transaction_id, ok, {sql_moment('transaction_time')} as transaction_time, round(score, 6) as score from a
    union all select 2, gantry_transaction_id, ok, {sql_moment('transaction_time')}, round(score, 6) from f where pick = 1""")
def q20(v):
    chosen = X.select_exemplars(dirty(v), CONDITION, 2, _ORDER)
    rows = chosen.select(
        "pick", "gantry_transaction_id", "ok", moment("transaction_time").alias("transaction_time"),
        F.col("exemplar_score").alias("score"),
    )
    return six(rows, "score")
