"""Column cleaning and scalar functions (C1-C14, C20, PV2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tollmill.functions import cleaning as C
from tollmill.functions import constants as K
from tollmill.functions import text as X
from tollmill.functions import vehicles as V
from tollmill.plans.registry import limit_of, period, query, sql_moment, whole, moment

# one loose text per transaction: padded, fractional, negative, wordy, empty, missing
_RAW = """case ok % 8 when 0 then concat('  ', fee_mileage, '  ') when 1 then concat(fee_mileage, '.45')
                  when 2 then concat('-', cast(pay_fee as {t}), '.45') when 3 then 'abc' when 4 then ''
                  when 5 then null when 6 then '12d' else total_weight end"""
_SQL_RAW = f"r as (select gantry_transaction_id, ok, {_RAW.replace('{t}', 'varchar')} as raw from v_gtx)"


def _raw(v):
    return v.gtx.select("gantry_transaction_id", "ok", F.expr(_RAW.replace("{t}", "string")).alias("raw"))


@query("c1_safe_int", f"""
    with {_SQL_RAW}
    select gantry_transaction_id, raw, coalesce(cast(trunc(try_cast(trim(raw) as double)) as bigint), -1) as value from r""")
def c1(v):
    return _raw(v).select("gantry_transaction_id", "raw", C.safe_int(F.col("raw"), -1).alias("value"))


@query("c2_safe_float", f"""
    with {_SQL_RAW}
    select gantry_transaction_id, raw, coalesce(try_cast(trim(raw) as double), 0.5) as value from r""")
def c2(v):
    return _raw(v).select("gantry_transaction_id", "raw", C.safe_float(F.col("raw"), 0.5).alias("value"))


_ISO = """case ok % 6 when 0 then {iso} when 1 then concat({iso}, 'Z') when 2 then concat(' ', {iso}, ' ')
          when 3 then 'not a time' when 4 then '' else null end"""


@query("c3_safe_timestamp", f"""
    with r as (select gantry_transaction_id, ok, {_ISO.replace('{iso}', "strftime(transaction_time, '%Y-%m-%dT%H:%M:%S')")} as raw from v_gtx)
    select gantry_transaction_id, raw, {sql_moment("try_cast(replace(trim(raw), 'Z', '') as timestamp)")} as value from r""")
def c3(v):
    iso = _ISO.replace("{iso}", "replace(left(cast(transaction_time as string), 19), ' ', 'T')")
    rows = v.gtx.select("gantry_transaction_id", F.expr(iso).alias("raw"))
    return rows.select("gantry_transaction_id", "raw", moment(C.safe_timestamp(F.col("raw"))).alias("value"))


@query("c4_extract_fields", """
    select gantry_transaction_id, coalesce(cast(trunc(try_cast(fee_mileage as double)) as bigint), 0) as mileage,
           cast(pay_fee as bigint) as fee, coalesce(try_cast(vehicle_type as bigint), 1) as kind from v_gtx""")
def c4(v):
    return v.gtx.select(
        "gantry_transaction_id", C.mileage_of(F.col("fee_mileage")).alias("mileage"),
        C.fee_of(F.col("pay_fee")).alias("fee"), C.vehicle_type_of(F.col("vehicle_type")).alias("kind"),
    )


_LOOSE = """ok % 4 as k, gantry_transaction_id, transaction_time, entrance_time, pay_fee,
    case ok % 4 when 0 then concat(vehicle_type, '.0') when 1 then '' when 2 then null else 'odd' end as vehicle_type,
    case ok % 4 when 0 then concat(total_weight, '.7') when 1 then '' when 2 then null else 'heavy' end as total_weight"""


@query("c5_coerce_codes", f"""
    with l as (select {_LOOSE} from v_gtx)
    select gantry_transaction_id, strftime(transaction_time, '%Y-%m-%dT%H:%M:%S') as transaction_time,
           strftime(entrance_time, '%Y-%m-%dT%H:%M:%S') as entrance_time, cast(pay_fee as bigint) as pay_fee,
           case when vehicle_type is null then null when vehicle_type = '' then '0'
                else coalesce(cast(cast(trunc(try_cast(vehicle_type as double)) as bigint) as varchar), vehicle_type) end as vehicle_type,
           case when total_weight is null then null
                else cast(coalesce(cast(trunc(try_cast(total_weight as double)) as bigint), 0) as varchar) end as total_weight
    from l""")
def c5(v):
    return C.coerce_codes(v.gtx.selectExpr(*_split(_LOOSE))).drop("k")


def _split(columns: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, item = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out, item = [*out, item.strip()], ""
        else:
            item += ch
    return [*out, item.strip()]


@query("c6_numeric_clean", """
    select gantry_transaction_id, cast(pay_fee as double) as pay_fee,
           coalesce(try_cast(fee_mileage as double), 0) as fee_mileage,
           coalesce(try_cast(axle_count as bigint), 0) as axle_count,
           case when ok % 3 = 0 then cast(total_weight as double) when ok % 3 = 1 then cast(total_weight as double) else 0 end as kg
    from v_gtx""")
def c6(v):
    unit = F.when(F.col("ok") % 3 == 0, F.concat("total_weight", F.lit("kg"))).when(
        F.col("ok") % 3 == 1, F.concat("total_weight", F.lit(" KG"))
    ).otherwise("heavy")
    rows = v.gtx.select("gantry_transaction_id", "pay_fee", "fee_mileage", "axle_count", C.weight_kg(unit).alias("kg"))
    return C.numeric_clean(rows)


_ODD_CODE = "case when ok % 13 = 0 then '999' when ok % 17 = 0 then 'abc' else vehicle_type end"
_CODE = whole("code")


@query("c7_vehicle_category", f"""
    with c as (select gantry_transaction_id, {_ODD_CODE} as code from v_gtx)
    select gantry_transaction_id,
           case when {_CODE} between 1 and 4 then '客车' when {_CODE} between 11 and 16 then '货车'
                when {_CODE} between 21 and 26 then '专项车' else '客车' end as category,
           coalesce({_CODE} between 1 and 4, false) as is_passenger,
           coalesce({_CODE} between 11 and 16 or {_CODE} between 21 and 26, false) as is_truck
    from c""")
def c7(v):
    code = F.expr(_ODD_CODE)
    return v.gtx.select(
        "gantry_transaction_id", V.vehicle_category(code).alias("category"),
        V.is_passenger(code).alias("is_passenger"), V.is_truck(code).alias("is_truck"),
    )


@query("c8_expected_axles", """
    select gantry_transaction_id, case vehicle_type when '13' then '3' when '14' then '4' when '16' then '6' else '2' end as axles
    from v_gtx""")
def c8(v):
    return v.gtx.select("gantry_transaction_id", V.expected_axles(F.col("vehicle_type")).alias("axles"))


@query("c9_axle_limit", f"select gantry_transaction_id, {limit_of('axle_count')} as limit_kg from v_gtx")
def c9(v):
    return v.gtx.select("gantry_transaction_id", V.axle_limit(F.col("axle_count")).alias("limit_kg"))


@query("c10_time_period", f"select gantry_transaction_id, {period('entrance_time')} as period from v_gtx")
def c10(v):
    return v.gtx.select("gantry_transaction_id", V.time_period(F.col("entrance_time")).alias("period"))


@query("c11_expected_fee", f"""
    select gantry_transaction_id,
           trunc(try_cast(fee_mileage as double) / 1000.0::double * (case vehicle_type when '1' then 0.45::double when '2' then 0.75::double
                when '3' then 1.05::double when '4' then 1.25::double else {K.FREIGHT_RATE!r}::double end) * 100.0::double) as expected
    from v_gtx""")
def c11(v):
    mileage = C.as_whole(F.col("fee_mileage"))
    return v.gtx.select("gantry_transaction_id", V.expected_fee(mileage, F.col("vehicle_type")).cast("double").alias("expected"))


@query("c12_time_parts", """
    select exit_transaction_id, strftime(exit_time, '%Y-%m-%d') as day, strftime(exit_time, '%Y-%m-%d %H') as hour_text,
           cast(hour(exit_time) as int) as hour, cast(isodow(exit_time) - 1 as int) as weekday,
           date_sub('minute', timestamp '1996-01-01 00:00:30', exit_time) as minutes,
           strftime(exit_time, '%Y-%m-%dT%H:%M:%S') as iso
    from v_exit""")
def c12(v):
    t = F.col("exit_time")
    since = F.lit("1996-01-01 00:00:30").cast("timestamp_ntz")
    return v.exit.select(
        "exit_transaction_id", C.day_label(t).alias("day"), C.hour_label(t).alias("hour_text"), F.hour(t).alias("hour"),
        F.weekday(t).alias("weekday"), C.minutes_between(since, t).alias("minutes"), C.iso_text(t).alias("iso"),
    )


@query("c13_section_code", """
    select exit_transaction_id, cast(right(regexp_replace(section_id, '[^0-9]', '', 'g'), 10) as bigint) as code,
           hour(exit_time) + minute(exit_time) / 60.0::double as day_fraction
    from v_exit""")
def c13(v):
    return v.exit.select(
        "exit_transaction_id", C.section_code(F.col("section_id")).alias("code"),
        C.day_fraction(F.col("exit_time")).alias("day_fraction"),
    )


@query("c14_numeric_functions", """
    select gantry_transaction_id, abs(pay_fee - 5000) as gap, greatest(100, least(5000, pay_fee)) as clipped,
           cast(sign(pay_fee - 5000) as double) as side, round(ln(pay_fee + 1), 6) as log_fee,
           round(1 / (1 + exp(-(pay_fee - 5000) / 1000.0::double)), 6) as sigmoid
    from v_gtx""")
def c14(v):
    fee = F.col("pay_fee")
    return v.gtx.select(
        "gantry_transaction_id", F.abs(fee - 5000).alias("gap"),
        F.greatest(F.lit(100), F.least(F.lit(5000), fee)).alias("clipped"), F.signum(fee - 5000).alias("side"),
        F.round(F.log(fee + F.lit(1.0)), 6).alias("log_fee"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(fee - 5000) / F.lit(1000.0))), 6).alias("sigmoid"),
    )


@query("c20_composite_id", """
    select gantry_transaction_id, gantry_id || strftime(transaction_time, '%Y%m%d%H%M%S') || lpad(cast(ok % 1000 as varchar), 6, '0') as composite
    from v_gtx""")
def c20(v):
    return v.gtx.select(
        "gantry_transaction_id",
        X.composite_id(F.col("gantry_id"), F.col("transaction_time"), F.col("ok") % 1000, 6).alias("composite"),
    )


@query("pv2_mask_id", """
    with i as (select toll_station_id, case when nullif(right(toll_station_id, 1), '7') is null then left(toll_station_id, 2) else section_id end as raw from v_station)
    select toll_station_id, case when raw is null or length(raw) < 3 then '***'
           else left(raw, 1) || repeat('*', length(raw) - 2) || right(raw, 1) end as masked from i""")
def pv2(v):
    raw = F.when(F.right("toll_station_id", F.lit(1)) == "7", F.left("toll_station_id", F.lit(2))).otherwise(F.col("section_id"))
    return v.station.select("toll_station_id", X.mask_id(raw).alias("masked"))
