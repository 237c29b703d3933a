"""Privacy queries (PV1, PV4-PV8; the masks are with the columns and the audit log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.operators import privacy as P
from tollmill.operators.filters import trucks_only
from tollmill.plans.registry import TRUCKS, query, sql_noisy, sql_uniform

K = 5
_OWN = f"""
    o as (select *, cast(right(regexp_replace(section_id, '[^0-9]', '', 'g'), 10) as bigint) as code,
                 hour(exit_time) + minute(exit_time) / 60.0::double as tod
          from v_exit where vehicle_class in {TRUCKS})"""
_CHUNKS = f"""{_OWN},
    n as (select *, row_number() over (order by code, tod, exit_transaction_id) as rn, count(*) over () as total from o),
    b as (select *, cast(least(floor((rn - 1) / {K}), greatest(floor(total / {K}) - 1, 0)) as bigint) as bucket,
                 left(regexp_replace(section_id, '[^0-9]', '', 'g'), 3) as prefix from n)"""
_LABELS = """
    pc as (select bucket, prefix, count(*) as c from b group by 1, 2),
    pr as (select *, row_number() over (partition by bucket order by c desc, prefix) as r, count(*) over (partition by bucket) as np from pc),
    h as (select bucket, cast(min(hour(exit_time)) as int) as lo, cast(max(hour(exit_time)) as int) as hi, count(*) as class_size from b group by 1),
    g as (select h.bucket, class_size, 'G' || prefix || case when np = 1 then '区域' else '等区域' end as section_region,
                 case when hi - lo <= 6 then case when lo < 6 then '凌晨时段(00-06)' when lo < 12 then '上午时段(06-12)'
                                                  when lo < 18 then '下午时段(12-18)' else '晚上时段(18-24)' end
                      else '时段(' || lpad(cast(lo as varchar), 2, '0') || '-' || lpad(cast(hi as varchar), 2, '0') || ')' end as time_period
          from h join pr on h.bucket = pr.bucket and r = 1)"""
_CLASSED = f"{_CHUNKS}, {_LABELS}"


def _split_sql(k: int) -> str:
    """The classes of recursive splits: points (code, tod) with their way, a letter a round."""
    off = "abs(2 * {0}_upto - total)"
    fits = f"{{0}}_upto >= {k} and total - {{0}}_upto >= {k}"
    best = f"min(case when {fits} then row({off}, {{0}}) end) over (partition by way)"
    return f"""{_OWN},
    p0 as (select coalesce(code, 0)::double as code, coalesce(tod, 0)::double as tod, count(*) as n from o group by 1, 2),
    spans as (select max(code) - min(code) as code_span, max(tod) - min(tod) as tod_span from p0),
    ways as (
      select code, tod, n, '' as way from p0
      union all
      select code, tod, n, way || case when along_code and code > code_cut or not along_code and tod > tod_cut then '1' else '0' end
      from (select *, code_best[2] as code_cut, tod_best[2] as tod_cut,
                   code_best is not null and (tod_best is null or coalesce(code_wide / nullif(code_span, 0), 0) >= coalesce(tod_wide / nullif(tod_span, 0), 0)) as along_code
            from (select *, {best.format('code')} as code_best, {best.format('tod')} as tod_best
                  from (select *, sum(n) over (partition by way order by code) as code_upto, sum(n) over (partition by way order by tod) as tod_upto,
                               sum(n) over (partition by way) as total, max(code) over (partition by way) - min(code) over (partition by way) as code_wide,
                               max(tod) over (partition by way) - min(tod) over (partition by way) as tod_wide from ways)), spans)
      where code_best is not null or tod_best is not null),
    last as (select code, tod, max_by(way, length(way)) as bucket from ways group by 1, 2),
    b as (select o.*, bucket, left(regexp_replace(section_id, '[^0-9]', '', 'g'), 3) as prefix
          from o join last on coalesce(o.code, 0) = last.code and coalesce(o.tod, 0) = last.tod),
    {_LABELS}"""


def _trucks(v):
    return trucks_only(v.exit, "vehicle_class")


@query("pv1_dp_count", f"""
    with c as (select section_id, count(*) as n from v_exit group by 1), u as (select *, {sql_uniform(11, 'section_id')} - 0.5::double as u from c)
    select section_id, n, {sql_noisy('n')} as n_dp, 1.0::double as epsilon, 'Laplace' as dp_method from u""")
def pv1(v):
    counts = v.exit.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return P.dp_count(counts, "n", 1.0, seed=11, keys=["section_id"])


@query("pv4_k_anonymize", f"""
    with {_CLASSED}
    select b.bucket, section_region, time_period, vehicle_class, axis_count, total_limit, total_weight,
           cast(toll_money as double) as toll_money, cast(real_money as double) as real_money, discount_type, true as k_anonymized
    from b join g on b.bucket = g.bucket""")
def pv4(v):
    return P.k_anonymize(_trucks(v), k=K)


@query("pv4_k_anonymize_split", f"""
    with {_split_sql(K)}
    select b.bucket, section_region, time_period, vehicle_class, axis_count, total_limit, total_weight,
           cast(toll_money as double) as toll_money, cast(real_money as double) as real_money, discount_type, true as k_anonymized
    from b join g on b.bucket = g.bucket""", recursive=True)
def pv4_split(v):
    return P.k_anonymize_split(_trucks(v), k=K)


@query("pv5_generalize_region", f"with {_CLASSED} select bucket, section_region from g")
def pv5(v):
    classed = P.chunk_classes(_trucks(v), K, "section_id", "exit_time", "exit_transaction_id")
    return P.generalize_region(classed, "bucket")


@query("pv6_generalize_period", f"with {_CLASSED} select bucket, time_period from g")
def pv6(v):
    classed = P.chunk_classes(_trucks(v), K, "section_id", "exit_time", "exit_transaction_id")
    return P.generalize_period(classed, "bucket")


@query("pv7_privacy_report", f"""
    select count(*) as total_records, count(*) as anonymized_records, cast(greatest(floor(count(*) / {K}), 1) as bigint) as equivalence_classes,
           0::bigint as suppressed_records, 100.0::double as retention_rate, {K} as k_value
    from v_exit where vehicle_class in {TRUCKS}""")
def pv7(v):
    rows = _trucks(v)
    return P.privacy_report(rows, P.k_anonymize(rows, k=K), K)


@query("pv8_k_violations", f"""
    with {_CLASSED}
    select section_region, time_period, cast(sum(class_size) as bigint) as n from g group by 1, 2 having sum(class_size) < {K}""")
def pv8(v):
    return P.k_violations(P.k_anonymize(_trucks(v), k=K), k=K)


@query("pv8_group_sizes", f"""
    with {_CLASSED}
    select section_region, time_period, cast(sum(class_size) as bigint) as n from g group by 1, 2""")
def pv8_sizes(v):
    anon = P.k_anonymize(_trucks(v), k=K)
    return anon.groupBy("section_region", "time_period").agg(F.count(F.lit(1)).alias("n"))
