"""Fidelity between two halves of the gantry transactions, and task scores (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.operators import fidelity as E
from tollmill.operators.profiling import profile_categorical, profile_datetime
from tollmill.plans.quality_queries import (
    _EXP_FEE, _OLD, COUNT, D, DATE_ERROR, HOURS, KIND, LEARNED, WEIGHT, dirty, learned_dates,
)
from tollmill.plans.registry import limit_of, period, query, six, whole

FIELDS = ["vehicle_type", "section_id", "media_type"]


def _counts(cols, empty_counts: bool, where: str = "") -> str:
    """Counts per (field, value) on the candidate (a) and the reference side (b)."""
    return " union all ".join(
        f"select '{c}' as field, {e} as value, count(case when ok % 2 = 1 then 1 end) as a, "
        f"count(case when ok % 2 = 0 then 1 end) as b from v_gtx where {e} is not null "
        f"{'' if empty_counts else f'''and {e} <> '' '''} group by 2"
        for c, e in cols.items()
    )


_PROBS = "p as (select *, a / sum(a) over (partition by field)::double as p, b / sum(b) over (partition by field)::double as q from n)"
_JS = """(coalesce(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) end), 0)
        + coalesce(sum(case when q > 0 then q * ln(q / ((p + q) / 2)) end), 0)) / 2"""


def _js_cte(name: str, cols) -> str:
    n = f"n_{name} as ({_counts(cols, False)})"
    p = _PROBS.replace("p as", f"p_{name} as", 1).replace("from n)", f"from n_{name})")
    return f"{n}, {p}, {name} as (select field, {_JS} as js from p_{name} group by 1)"


DIST = _js_cte("dist", {c: c for c in FIELDS})
TEMP = _js_cte("temp", {"time_period": period("transaction_time")})


@query("e1_js_divergence", f"""
    with {DIST} select field, round(js, 6) as js_divergence, round(1 / (1 + js), 6) as similarity from dist""")
def e1(v):
    return six(E.js_divergence(v.odd, v.even), "js_divergence", "similarity")


CATEGORICAL = ["vehicle_type", "media_type", "pass_state", "axle_count"]
_SMOOTH = f"""n as ({_counts({c: c for c in CATEGORICAL}, True)}), {_PROBS},
    k as (select *, case when p > 0 then p else 1e-10::double end as sp, case when q > 0 then q else 1e-10::double end as sq, (p + q) / 2 as mid from p),
    f as (select field, (sum(sp * ln(sp / mid)) + sum(sq * ln(sq / mid))) / 2 as js from k group by 1)"""


@query("e2_kl_js_smoothed", f"""
    with {_SMOOTH}
    select field, round(js, 6) as js_divergence, round(1 / (1 + js), 6) as similarity from f
    union all select 'overall', round(avg(js), 6), round(avg(1 / (1 + js)), 6) from f""")
def e2(v):
    return six(E.kl_js_smoothed(v.odd, v.even), "js_divergence", "similarity")


def _moments(c: str, e: str) -> str:
    return f"""select '{c}' as field, avg(case when ok % 2 = 1 then {e} end) as ma, avg(case when ok % 2 = 0 then {e} end) as mb,
        stddev_pop(case when ok % 2 = 1 then {e} end) as sa, stddev_pop(case when ok % 2 = 0 then {e} end) as sb from v_gtx"""


STAT = f"""stat as (select *, (1 / (1 + abs(ma - mb) / (mb + 1e-10::double)) + 1 / (1 + abs(sa - sb) / (sb + 1e-10::double))) / 2 as sim from (
    {_moments('pay_fee', 'nullif(pay_fee, 0)')} union all {_moments('fee_mileage', "try_cast(nullif(fee_mileage, '') as double)")}))"""


@query("e3_numeric_similarity", f"""
    with {STAT}
    select field, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(sa, 6) as std_a, round(sb, 6) as std_b,
           round(1 / (1 + abs(ma - mb) / (mb + 1e-10::double)), 6) as mean_similarity,
           round(1 / (1 + abs(sa - sb) / (sb + 1e-10::double)), 6) as std_similarity, round(sim, 6) as similarity from stat""")
def e3(v):
    return six(
        E.numeric_similarity(v.odd, v.even), "mean_a", "mean_b", "std_a", "std_b", "mean_similarity", "std_similarity", "similarity"
    )


@query("e4_temporal_similarity", f"""
    with {TEMP} select field, round(js, 6) as js_divergence, round(1 / (1 + js), 6) as similarity from temp""")
def e4(v):
    return six(E.temporal_similarity(v.odd, v.even), "js_divergence", "similarity")


CORR = """pairs as (select ok, case when vehicle_type in ('1','2','3','4','5') then 'passenger' else 'truck' end as vehicle_class,
        pay_fee::double as fee, coalesce(try_cast(fee_mileage as double), 0) as mileage from v_gtx),
    cor as (select vehicle_class, corr(fee, mileage) filter (where ok % 2 = 1) as ca, corr(fee, mileage) filter (where ok % 2 = 0) as cb,
                 count(*) filter (where ok % 2 = 1) as na, count(*) filter (where ok % 2 = 0) as nb
          from pairs where fee > 0 and mileage > 0 group by 1)"""


@query("e5_correlation_similarity", f"""
    with {CORR}
    select vehicle_class, round(ca, 6) as corr_a, na as n_a, round(cb, 6) as corr_b, nb as n_b, round(1 / (1 + abs(ca - cb)), 6) as similarity from cor""")
def e5(v):
    return six(E.correlation_similarity(v.odd, v.even), "corr_a", "corr_b", "similarity")


BENCH = f"""{DIST}, {STAT}, {TEMP}, {CORR},
    parts as (select (select avg(1 / (1 + js)) from dist) as d, (select avg(sim) from stat) as s, (select avg(1 / (1 + js)) from temp) as t,
                     (select sum(1 / (1 + abs(ca - cb)) * na) / sum(na) from cor) as c),
    bench as (select *, d * 0.35::double + s * 0.25::double + t * 0.20::double + c * 0.20::double as overall from parts)"""


@query("e6_benchmark_similarity", f"""
    with {BENCH}
    select round(d, 6) as distribution_similarity, round(s, 6) as statistical_similarity, round(t, 6) as temporal_similarity,
           round(c, 6) as correlation_similarity, round(overall, 6) as overall_similarity,
           case when overall >= 0.95 then '优秀' when overall >= 0.85 then '良好' else '需改进' end as verdict from bench""")
def e6(v):
    return six(
        E.benchmark_similarity(v.odd, v.even), "distribution_similarity", "statistical_similarity", "temporal_similarity",
        "correlation_similarity", "overall_similarity",
    )


def _checks(where: str) -> str:
    return f"""x as (select *, {COUNT} as n_issues, {DATE_ERROR.format('d')} as wrong_date from d {where}),
    chk as (select count(case when n_issues <= 1 and not wrong_date then 1 end) as valid_count, count(*) as total_count,
                   count(case when wrong_date then 1 end) as section_date_errors from x)"""


@query("e7_faithfulness", f"""
    with {D}, {LEARNED}, {_checks('')}
    select *, valid_count / total_count::double as constraint_score, valid_count / total_count::double as score from chk""")
def e7(v):
    return E.faithfulness(dirty(v), learned_dates(v))


@query("e7_faithfulness_with_reference", f"""
    with d as (select * from v_gtx where ok % 2 = 1), {LEARNED}, {_checks('')}, {BENCH}
    select chk.*, round(valid_count / total_count::double, 6) as constraint_score,
           round(valid_count / total_count::double * 0.5::double + overall * 0.5::double, 6) as score from chk, bench""")
def e7_reference(v):
    return six(E.faithfulness(v.odd, learned_dates(v), v.even), "constraint_score", "score")


DIV = f"""cnt as (select count(distinct vehicle_type) as n_vehicle_type, count(distinct gantry_id) as n_gantry_id,
    count(distinct section_id) as n_section_id, count(distinct gantry_transaction_id) as n_gantry_transaction_id,
    count(distinct {period('transaction_time')}) as n_time_period, count(*) as n_rows,
    count(distinct gantry_transaction_id) / count(*)::double as uniqueness from {{0}}),
    div as (select *, least(n_vehicle_type / 10.0::double, 1) * 0.2::double + least(n_gantry_id / 30.0::double, 1) * 0.25::double
      + least(n_section_id / 8.0::double, 1) * 0.2::double + least(n_time_period / 4.0::double, 1) * 0.15::double + uniqueness * 0.2::double as score from cnt)"""


@query("e8_diversity", f"with {DIV.format('v_gtx')} select * replace (round(score, 6) as score) from div")
def e8(v):
    return six(E.diversity(v.gtx), "score")


@query("e9_direct_score", f"""
    with {D}, {LEARNED}, {_checks('')}, {DIV.format('d')}
    select round(valid_count / total_count::double, 6) as faithfulness, round(score, 6) as diversity,
           round(valid_count / total_count::double * 0.6::double + score * 0.4::double, 6) as overall_score from chk, div""")
def e9(v):
    return six(E.direct_score(dirty(v), learned_dates(v)), "faithfulness", "diversity", "overall_score")


ANOMALY = f"""ano as (select count(*) as total_samples, count(case when pass_state = '2' then 1 end) as anomaly_samples,
    count(case when pass_state = '2' and {WEIGHT} > {limit_of('axle_count')} then 1 end) as true_positives from v_gtx)"""


@query("e10_task_anomaly", f"with {ANOMALY} select *, true_positives / anomaly_samples::double as precision from ano")
def e10(v):
    return E.task_anomaly(v.gtx)


FEE = f"""fr as (select case when vehicle_type in ('1','2','3','4') then 'passenger' else 'truck' end as kind, pay_fee as fee,
        {whole('fee_mileage')} as mileage from v_gtx),
    fc as (select kind, count(*) as n_all, count(case when fee <> 0 and mileage <> 0 then 1 end) as n,
        avg(case when fee <> 0 and mileage <> 0 then fee / mileage::double end) as m,
        stddev_pop(case when fee <> 0 and mileage <> 0 then fee / mileage::double end) as s,
        count(case when mileage = 0 then 1 end) as zm, count(case when mileage <> 0 and fee = 0 then 1 end) as zf from fr group by 1),
    fee as (select cast(sum(n) as bigint) as samples_evaluated, cast(sum(n_all) - sum(n) as bigint) as samples_failed,
        cast(sum(zm) as bigint) as zero_mileage_count, cast(sum(zf) as bigint) as zero_fee_count,
        avg(case when n >= 2 then greatest(0, 1 - s / m) end) as accuracy from fc)"""


@query("e11_task_fee", f"with {FEE} select * replace (round(accuracy, 6) as accuracy) from fee")
def e11(v):
    return six(E.task_fee(v.gtx), "accuracy")


@query("e12_task_fee_formula", f"""
    with t as (select case when {whole('fee_mileage')} is not null
                      then case when {_EXP_FEE} > 0 then abs(pay_fee - {_EXP_FEE}) / {_EXP_FEE}::double else 0 end end as err from v_gtx)
    select count(err) as samples_evaluated, round(avg(err), 6) as mean_absolute_error, round(greatest(0, 1 - avg(err)), 6) as accuracy from t""")
def e12(v):
    return six(E.task_fee_formula(v.gtx), "mean_absolute_error", "accuracy")


VEHICLE = f"""veh as (select count(case when {KIND} is not null and {WEIGHT} is not null then 1 end) as total_samples,
    count(case when ({KIND} between 1 and 4 and axle_count = '2' and {WEIGHT} between 2000 and 5000)
                 or ({KIND} between 11 and 16 and {WEIGHT} <= {limit_of('axle_count')} * 1.2::double) then 1 end) as correct_predictions from v_gtx)"""


@query("e13_task_vehicle", f"with {VEHICLE} select *, correct_predictions / total_samples::double as accuracy from veh")
def e13(v):
    return E.task_vehicle(v.gtx)


TIME = f"""tim as (select count(case when entrance_time is not null and transaction_time is not null then 1 end) as total_samples,
    count(case when entrance_time < transaction_time and {HOURS} between 0.5 and 6 then 1 end) as valid_samples,
    avg(case when entrance_time < transaction_time then {HOURS} end) as avg_time_diff_hours from v_gtx)"""


@query("e14_task_time", f"""
    with {TIME} select total_samples, valid_samples, round(avg_time_diff_hours, 6) as avg_time_diff_hours,
                       valid_samples / total_samples::double as accuracy from tim""")
def e14(v):
    return six(E.task_time(v.gtx), "avg_time_diff_hours")


@query("e15_task_overall", f"""
    with {ANOMALY}, {FEE}, {VEHICLE}, {TIME},
    p as (select (select true_positives / anomaly_samples::double from ano) as a, (select accuracy from fee) as f,
                 (select correct_predictions / total_samples::double from veh) as v, (select valid_samples / total_samples::double from tim) as t)
    select round(a, 6) as anomaly_detection, round(f, 6) as fee_prediction, round(v, 6) as vehicle_classification,
           round(t, 6) as time_consistency, round((a + f + v + t) / 4, 6) as score from p""")
def e15(v):
    return six(
        E.task_overall(v.gtx), "anomaly_detection", "fee_prediction", "vehicle_classification", "time_consistency", "score"
    )


@query("e16_legacy_diversity", f"""
    with {D}
    select least(1, (count(distinct vehicle_type) + count(distinct gantry_id) / 2.0::double + count(distinct section_id) / 2.0::double)
                    / (least(count(*), 10) * 2)) as diversity,
           round(avg(case when {_OLD} = 0 then 1.0::double else 0 end), 6) as fidelity from d""")
def e16(v):
    return six(E.legacy_diversity(dirty(v)), "fidelity")


@query("e17_compare_top_values", f"""
    with {_SMOOTH},
    ra as (select *, cast(row_number() over (partition by field order by p desc, value) as int) as rank from p where p > 0),
    rb as (select *, cast(row_number() over (partition by field order by q desc, value) as int) as rank from p where q > 0),
    j as (select coalesce(x.field, y.field) as field, coalesce(x.rank, y.rank) as rank, x.value as value_a, x.p as prob_a, y.value as value_b, y.q as prob_b
          from (select * from ra where rank <= 3) x full join (select * from rb where rank <= 3) y on x.field = y.field and x.rank = y.rank)
    select j.*, round(1 / (1 + js), 6) as similarity from j join f on j.field = f.field""")
def e17(v):
    return six(E.compare_top_values(v.odd, v.even), "similarity")


@query("e17_major_values", " union all ".join(f"""
    select * from (select '{c}' as field, {c} as value, count(*) as cnt, count(*) / sum(count(*)) over ()::double as prob
                   from v_gtx where {c} is not null group by 2) where prob > 0.01"""
    for c in ("vehicle_type", "gantry_id", "fee_mileage")))
def e17_major(v):
    return E.major_values(profile_categorical(v.gtx, ["vehicle_type", "gantry_id", "fee_mileage"]))


@query("e17_peak_hours", " union all ".join(f"""
    select * from (select '{c}' as field, 'hour' as unit, cast(hour({c}) as int) as value, count(*) as cnt,
                          count(*) / sum(count(*)) over ()::double as prob
                   from v_gtx where {c} is not null group by 3 order by 4 desc, 3 limit 5)""" for c in K.DATETIME_FIELDS))
def e17_peaks(v):
    return E.peak_hours_of(profile_datetime(v.gtx))
