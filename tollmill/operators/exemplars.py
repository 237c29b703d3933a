"""Scores that rank gantry transactions as exemplars, and a small diverse selection of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import drop_parsed, is_present, parse_whole, seconds_between, time_of, whole_of
from tollmill.functions.vehicles import axle_limit, expected_fee, truck_code
from tollmill.operators.quality import field


def quality_of(df: DataFrame) -> Column:
    """Product of completeness, time, fee, discount and vehicle factors."""
    needed = ["gantry_id", "vehicle_type", "transaction_time", "entrance_time", "pay_fee", "fee_mileage"]
    missing = sum((F.when(is_present(df, c), 0).otherwise(1) for c in needed), F.lit(0))
    complete = F.lit(0.3) * (F.lit(1.0) - missing / F.lit(6.0)) + F.lit(0.7)

    start, end = time_of(df, "entrance_time"), time_of(df, "transaction_time")
    hours = seconds_between(start, end) / F.lit(3600.0)
    time = (
        F.when(start.isNull() | end.isNull(), 0.5).when(start >= end, 0.3)
        .when(hours.between(0.5, 6), 1.0).otherwise(0.8)
    )

    fee, discount = whole_of(df, "pay_fee"), whole_of(df, "discount_fee")
    mileage = whole_of(df, "fee_mileage")
    readable = fee.isNotNull() & discount.isNotNull() & mileage.isNotNull()
    expected = expected_fee(mileage, F.col("vehicle_type"))
    # a tariff of 0 gives NULL; fees and tariffs are never negative where both are positive
    ratio = F.try_divide(F.when(fee > 0, fee), expected)
    fair = F.coalesce(ratio.between(0.7, 1.3), F.lit(False))
    amount = F.when(~readable, 0.6).when(fair, 1.0).otherwise(0.7)
    rebate = F.when(readable & (discount > fee), 0.4).otherwise(1.0)

    kind = whole_of(df, "vehicle_type")
    two = F.col("axle_count").eqNullSafe(F.lit("2"))
    vehicle = F.when(kind.isNull(), 0.7).when(kind.between(1, 4) & ~two, 0.6).otherwise(1.0)
    return complete * time * amount * rebate * vehicle


_TEXT_NUMBERS = ["vehicle_type", "total_weight", "fee_mileage"]


def _with(df: DataFrame, name: str, score) -> DataFrame:
    parsed = parse_whole(df, *_TEXT_NUMBERS)
    return drop_parsed(parsed.withColumn(name, score(parsed)))


def exemplar_quality(df: DataFrame) -> DataFrame:
    return _with(df, "quality", quality_of)


def _over_limit(df: DataFrame) -> Column:
    weight = whole_of(df, "total_weight", 0)
    return F.coalesce(weight > axle_limit(field(df, "axle_count", "2")), F.lit(False))


def similarity_of(df: DataFrame, condition: dict) -> Column:
    """Match with a condition on class (0.4), scenario (0.3) and period (0.3); an unset part gives half."""
    kind, scenario, period = (condition.get(k) for k in ("vehicle_type", "scenario", "time_period"))
    readable = whole_of(df, "vehicle_type").isNotNull()
    truck = truck_code(whole_of(df, "vehicle_type"))
    wanted = {K.TRUCK: truck, K.PASSENGER: ~truck}.get(kind, F.lit(False))
    a = F.lit(0.2) if not kind else F.when(readable & wanted, 0.4).otherwise(0.0)

    if not scenario:
        b = F.lit(0.15)
    elif scenario == K.OVERLOADED:
        b = F.when(_over_limit(df), 0.3).otherwise(0.0)
    elif scenario == K.STATUS_ABNORMAL:
        b = F.when(field(df, "pass_state").eqNullSafe(F.lit("2")), 0.3).otherwise(0.0)
    else:
        b = F.lit(0.0)

    hour = F.hour(time_of(df, "transaction_time"))
    within = {
        K.MORNING_PEAK: hour.between(7, 8), K.EVENING_PEAK: hour.between(17, 18),
        K.NIGHT: (hour >= 23) | (hour < 5), K.OFF_PEAK: hour.isNotNull(),
    }.get(period, F.lit(False))
    c = F.lit(0.15) if not period else F.when(within, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), a + b + c)


def similarity(df: DataFrame, condition: dict) -> DataFrame:
    return _with(df, "similarity", lambda d: similarity_of(d, condition))


def difficulty_of(df: DataFrame) -> Column:
    """0.5, raised for trucks, special vehicles, weights near the limit, state 2 and unusual transactions."""
    kind = whole_of(df, "vehicle_type")
    ratio = whole_of(df, "total_weight") / axle_limit(F.col("axle_count"))
    by_class = F.when(kind.between(11, 16), 0.15).when(kind.between(21, 26), 0.25).otherwise(0.0)
    near = F.when(ratio.between(0.85, 1.15), 0.2).otherwise(0.0)
    state = F.when(field(df, "pass_state").eqNullSafe(F.lit("2")), 0.15).otherwise(0.0)
    unusual = F.when(field(df, "transaction_type").eqNullSafe(F.lit("1")), 0.0).otherwise(0.1)
    return F.least(F.lit(1.0), F.lit(0.5) + by_class + near + state + unusual)


def difficulty(df: DataFrame) -> DataFrame:
    return _with(df, "difficulty", difficulty_of)


def rank_exemplars(df: DataFrame, condition: dict) -> DataFrame:
    """Rows of quality 0.5 or more with their combined score (0.4 quality, 0.4 similarity, 0.2 difficulty)."""
    df = parse_whole(df, *_TEXT_NUMBERS)
    scored = df.withColumns(
        {"quality": quality_of(df), "similarity": similarity_of(df, condition), "difficulty": difficulty_of(df)}
    )
    total = F.col("quality") * 0.4 + F.col("similarity") * 0.4 + F.col("difficulty") * 0.2
    return drop_parsed(scored.filter(F.col("quality") >= 0.5).withColumn("exemplar_score", total))


def _distance(a: Column, b: Column) -> Column:
    def gap(x: Column, width: float, cap: bool = True) -> Column:
        d = F.abs(x) / F.lit(width)
        return F.coalesce(F.least(d, F.lit(1.0)) if cap else d, F.lit(0.0))

    total = (
        gap(a["kind"] - b["kind"], 26.0, cap=False) + gap(a["mileage"] - b["mileage"], 200000.0)
        + gap(a["hour"] - b["hour"], 24.0)
    )
    return total / F.lit(3.0)


def select_exemplars(df: DataFrame, condition: dict, k: int = 2, order: list | None = None) -> DataFrame:
    """k exemplars: the best row, then each time the row farthest from all chosen ones, out of the best 2k.

    The pool has 2k rows, so the picks are made inside one array. ``order`` breaks ties of the score.
    """
    ranked = rank_exemplars(df, condition)
    columns = [c for c in df.columns]
    pool = ranked.orderBy(F.desc("exemplar_score"), *(order or columns)).limit(2 * k)
    packed = F.struct(
        (-F.col("exemplar_score")).alias("rank"), *(order or columns),
        F.struct(*columns, "exemplar_score").alias("row"),
        whole_of(df, "vehicle_type").alias("kind"), whole_of(df, "fee_mileage").alias("mileage"),
        F.hour(time_of(df, "transaction_time")).alias("hour"),
    )
    sorted_pool = pool.agg(F.array_sort(F.collect_list(packed)).alias("pool"))
    plain = F.transform(
        "pool", lambda x, i: F.struct((-i).alias("i"), x["row"].alias("row"), x["kind"].alias("kind"),
                                      x["mileage"].alias("mileage"), x["hour"].alias("hour"))
    )
    table = sorted_pool.select(plain.alias("pool")).filter(F.size("pool") > 0)
    picked = table.withColumn("chosen", F.slice("pool", 1, 1))
    for _ in range(k - 1):
        left = F.filter("pool", lambda c: ~F.exists("chosen", lambda s: s["i"] == c["i"]))
        gaps = F.transform(
            left,
            lambda c: F.struct(
                F.array_min(F.transform("chosen", lambda s: _distance(c, s))).alias("gap"), c["i"].alias("i"), c.alias("c")
            ),
        )
        # the largest gap wins, then the better rank (i counts down from 0)
        best = F.reduce(
            gaps, F.try_element_at(gaps, F.lit(1)),
            lambda acc, x: F.when(F.struct(x["gap"], x["i"]) > F.struct(acc["gap"], acc["i"]), x).otherwise(acc),
        )
        grown = F.concat("chosen", F.array(best["c"]))
        picked = picked.withColumn("chosen", F.when(F.size("pool") > F.size("chosen"), grown).otherwise(F.col("chosen")))
    out = picked.select(F.posexplode("chosen").alias("pick", "c"))
    return out.select((F.col("pick") + 1).alias("pick"), "c.row.*")
