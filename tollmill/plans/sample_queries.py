"""Learned checks (M*), resampling and rebalancing (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.vehicles import freight_class
from tollmill.operators import forest as I
from tollmill.operators import learn as M
from tollmill.operators import sampling as G
from tollmill.operators.profiling import fee_mileage_stats, profile_categorical
from tollmill.plans.quality_queries import FREIGHT
from tollmill.plans.registry import query, six, sql_uniform

_KIND = "coalesce(try_cast(vehicle_type as double), 1)"
_FEE = "cast(pay_fee as double)"
_KM = "coalesce(try_cast(fee_mileage as double), 0)"
_KG = "coalesce(try_cast(total_weight as double), 0)"
_AXLES = "coalesce(try_cast(axle_count as double), 2)"
FEATURES = {
    "vehicle_type": _KIND, "pay_fee": _FEE, "fee_mileage": _KM, "total_weight": _KG, "axle_count": _AXLES,
    "fee_per_km": f"{_FEE} / ({_KM} + 1)", "weight_per_axle": f"{_KG} / ({_AXLES} + 1)",
}


@query("m1_features", f"""
    select gantry_transaction_id, ok, {', '.join(f'{e} as f_{n}' for n, e in FEATURES.items())} from v_gtx""")
def m1(v):
    return M.features(v.gtx).select("gantry_transaction_id", "ok", *[f"f_{n}" for n in M.FEATURES])


@query("m2_predict_fee")
def m2(v):
    model = M.fit_fee_model(v.even)
    return M.predict_fee(model, v.odd).groupBy("vehicle_type", "fee_anomalous").agg(F.count(F.lit(1)).alias("cnt"))


_Z = " + ".join(f"power(({e} - {n}_m) / {n}_s, 2)" for n, e in FEATURES.items())


@query("m3_distance_anomaly", f"""
    with st as (select {', '.join(f'avg({e}) as {n}_m, stddev_pop({e}) as {n}_s' for n, e in FEATURES.items())} from v_gtx where ok % 2 = 0),
    lim as (select quantile_cont({_Z}, 0.9) as cut from v_gtx, st where ok % 2 = 0)
    select vehicle_type, count(*) as cnt, count(case when {_Z} > cut then 1 end) as anomalous
    from v_gtx, st, lim where ok % 2 = 1 group by 1""")
def m3(v):
    marked = M.distance_anomaly(v.odd, v.even)
    return marked.groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.count(F.when(F.col("distance_anomalous"), 1)).alias("anomalous")
    )


def _forest_sql() -> str:
    """The isolation forest as SQL: the same draws and cuts, trees as lists by node."""
    n, levels, trees, size = len(FEATURES), 8, I.TREES, I.SIZE
    ways = "[" + ", ".join(str(I.mean_way(i)) for i in range(size + 1)) + "]"
    parts = [f"""f as materialized (select row_number() over () as rid, ok, vehicle_type, gantry_transaction_id as k, [{', '.join(f'coalesce({e}, 0)::double' for e in FEATURES.values())}] as x from v_gtx),
    pool as materialized (select x, row_number() over (order by u, k, x) - 1 as r from (select x, k, {sql_uniform(42, 'k')} as u from f where ok % 2 = 0) order by u, k, x limit {trees * size}),
    size as (select count(*) as n from pool), s0 as materialized (
      select t.range as tree, x, 1 as node from pool, size, range(0, {trees}) t
      where (((r - t.range * n // {trees}) % n) + n) % n < least({size}, n))"""]
    for level in range(levels + 1):
        feature = f"coalesce(list_filter([(first + i) % {n} for i in range(0, {n})], lambda f: low[f + 1] < high[f + 1])[1], -1)" if level < levels else "-1"
        parts.append(f"""n{level} as materialized (
          select tree, node, feature, case when feature >= 0 then low[feature + 1] + v * (high[feature + 1] - low[feature + 1]) end as cut, {ways}[n + 1] + {level * I.UNIT} as way
          from (select *, {feature} as feature from (
            select tree, node, count(*) as n, [{', '.join(f'min(x[{i + 1}])' for i in range(n))}] as low, [{', '.join(f'max(x[{i + 1}])' for i in range(n))}] as high,
                   floor({sql_uniform(43, 'tree', 'node')} * {n})::bigint as first, {sql_uniform(44, 'tree', 'node')} as v
            from s{level} group by tree, node)))""")
        if level < levels:
            parts.append(f"""s{level + 1} as materialized (select s.tree, s.x, s.node * 2 + case when s.x[feature + 1] >= cut then 1 else 0 end as node
              from s{level} s join n{level} using (tree, node) where feature >= 0)""")
    parts.append(f"w0 as (select rid, t.range as tree, 1 as node from f, range(0, {trees}) t)")
    for level in range(levels + 1):
        met = f"w{level} w left join n{level} n using (tree, node)"
        parts.append(f"d{level} as (select rid, coalesce(way, {level * I.UNIT}) as way from {met} where coalesce(feature, -1) < 0)")
        if level < levels:
            parts.append(f"""w{level + 1} as materialized (select w.rid, w.tree, w.node * 2 + case when f.x[feature + 1] >= cut then 1 else 0 end as node
              from {met} join f on f.rid = w.rid where feature >= 0)""")
    parts.append(f"""walked as materialized (select rid, sum(way)::double as way from ({' union all '.join(f'select * from d{i}' for i in range(levels + 1))}) group by rid),
    lim as (select quantile_cont(way, 0.1) as cut from walked join f using (rid) where ok % 2 = 0)""")
    return "with " + ", ".join(parts) + """
    select vehicle_type, count(*) as cnt, count(case when way < cut then 1 end) as anomalous, cast(sum(way) as bigint) as ways
    from walked join f using (rid), lim where ok % 2 = 1 group by 1"""


@query("m3_isolation_forest", _forest_sql())
def m3_forest(v):
    marked = M.isolation_anomaly(v.odd, v.even, way="_ways")
    return marked.groupBy("vehicle_type").agg(
        F.count(F.lit(1)).alias("cnt"), F.count(F.when(F.col("isolation_anomalous"), 1)).alias("anomalous"), F.sum("_ways").cast("long").alias("ways")
    )


@query("m4_verify")
def m4(v):
    checked = M.verify(v.odd, v.even)
    return checked.groupBy("vehicle_type", F.col("_auxiliary_result").alias("verdict")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count("_discriminative_corrected").alias("corrected")
    )


_G1_COLS = ["gantry_id", "vehicle_type", "media_type", "pass_state"]


def _g1_bounds(c: str, given: str) -> str:
    return f"""
        select '{c}' as col, given, value, sum(cnt) over (partition by given order by value) as e, cnt, sum(cnt) over (partition by given) as t
        from (select {given} as given, cast({c} as varchar) as value, count(*) as cnt from v_gtx
              where {c} is not null {'and ' + given + ' is not null' if given != "null::varchar" else ''} group by 1, 2)"""


_G1_DRAWS = "ids as (select range as id from range(0, (select count(*) from v_gtx)))"
for _i, _c in enumerate(_G1_COLS):
    _G1_DRAWS += f""",
    b{_i} as ({_g1_bounds(_c, 'null::varchar')}), d{_i} as (
      select id, value as {_c} from (select id, {sql_uniform(42 + _i, 'id')} as u from ids) r asof join
             (select value, (e - cnt) / t::double as lower from b{_i}) b on r.u >= b.lower)"""


@query("g1_resample", f"""
    with {_G1_DRAWS},
    b9 as ({_g1_bounds('axle_count', 'vehicle_type')}),
    d9 as (select id, value as axle_count from (select id, vehicle_type, {sql_uniform(1042, 'id')} as u from d1) r asof join
             (select given, value, (e - cnt) / t::double as lower from b9) b on r.vehicle_type = b.given and r.u >= b.lower),
    v as ({' union all '.join(f"select '{c}' as field, {c} as value from d{i}" for i, c in [*enumerate(_G1_COLS), (9, 'axle_count')])})
    select field, value, count(*) as cnt, count(*) / sum(count(*)) over (partition by field)::double as prob from v group by 1, 2""")
def g1(v):
    n = v.gtx.count()
    drawn = G.resample(v.gtx, n, gantry_map=v.gantry_map)
    return profile_categorical(drawn, ["gantry_id", "vehicle_type", "axle_count", "media_type", "pass_state"])


@query("g2_conditional_normal")
def g2(v):
    n = v.gtx.count()
    pairs = G.conditional_normal(v.spark, fee_mileage_stats(v.gtx), n)
    return six(pairs.groupBy("vehicle_class").agg(
        F.count(F.lit(1)).alias("cnt"), F.avg("fee").alias("fee_mean"), F.avg("mileage").alias("mileage_mean"),
        F.corr(F.col("fee").cast("double"), F.col("mileage").cast("double")).alias("correlation"),
    ), "fee_mean", "mileage_mean", "correlation")


_CLASS = f"case when coalesce({FREIGHT}, false) then '货车' else '客车' end"


@query("g3_quota_plan", f"""
    with c as (select {_CLASS} as stratum, count(*) as available from v_gtx group by 1),
    t as (select unnest(['货车', '客车']) as stratum, unnest([0.6::double, 0.4::double]) as target, unnest([6000, 4000])::bigint as quota)
    select t.*, available, available / (select sum(available) from c)::double as current,
           target - available / (select sum(available) from c)::double as gap
    from t join c on t.stratum = c.stratum""")
def g3_plan(v):
    return G.quota_plan(v.gtx, freight_class(F.col("vehicle_type")), K.CLASS_TARGET, 10_000)


_KEYED = ["gantry_transaction_id", "gantry_id", "vehicle_type", "pay_fee", "fee_mileage"]


@query("g3_rebalance", f"""
    with k as (select {', '.join(_KEYED)}, {_CLASS} as stratum,
                      md5(concat_ws('|', {', '.join(f'''coalesce(cast({c} as varchar), chr(92) || 'N')''' for c in _KEYED)})) as key from v_gtx),
    r as (select *, row_number() over (partition by stratum order by key) as rn from k)
    select {', '.join(_KEYED)} from r where rn <= case stratum when '货车' then 6000 else 4000 end""")
def g3(v):
    return G.rebalance(v.gtx.select(*_KEYED), K.CLASS_TARGET, 10_000, freight_class(F.col("vehicle_type")))
