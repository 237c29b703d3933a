"""Rule checks, repair, re-weighting and corrections of gantry transactions.

Every check is a column expression: one scan scores all rules, and repaired rows are
scored again in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollmill.functions import constants as K
from tollmill.functions.cleaning import (
    as_whole, day_label, drop_parsed, iso_text, is_present, number_of, parse_whole, seconds_between, time_of, whole_of,
)
from tollmill.functions.vehicles import axle_limit, expected_axles, freight_class, lookup, passenger_code, truck_code
from tollmill.operators.ordering import first_part, top_k
from tollmill.operators.relational import repair_section
from tollmill.session import freeze


def field(df: DataFrame, name: str, default=None) -> Column:
    """A column, or its default where the table has no such column."""
    return F.col(name) if name in df.columns else F.lit(default)


def _times(df: DataFrame) -> tuple[Column, Column]:
    return time_of(df, "entrance_time"), time_of(df, "transaction_time")


def _hours(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def time_issue(df: DataFrame, max_hours: float = 6) -> Column:
    start, end = _times(df)
    return (
        F.when(start.isNull() | end.isNull(), K.ISSUE_TIME_FORMAT)
        .when(start >= end, K.ISSUE_TIME_ORDER)
        .when(_hours(start, end) > max_hours, K.ISSUE_TIME_LONG)
    )


def fee_issue(df: DataFrame) -> Column:
    fee, discount = whole_of(df, "pay_fee", 0), whole_of(df, "discount_fee", 0)
    return (
        F.when(fee.isNull() | discount.isNull(), K.ISSUE_FEE_FORMAT)
        .when((discount > fee) | (fee < 0), K.ISSUE_FEE)
    )


def vehicle_issue(df: DataFrame, slack: float = 1.5) -> Column:
    kind, axles = whole_of(df, "vehicle_type", 1), field(df, "axle_count", "2")
    weight = whole_of(df, "total_weight", 0)
    freight = kind.between(11, 16) | kind.between(21, 26)
    return (
        F.when(kind.isNull(), K.ISSUE_VEHICLE_FORMAT)
        .when(kind.between(1, 4) & ~axles.eqNullSafe(F.lit("2")), K.ISSUE_AXLE)
        .when(freight & (weight > axle_limit(axles) * F.lit(slack)), K.ISSUE_WEIGHT)
    )


def missing_issue(df: DataFrame) -> Column:
    needed = ["gantry_transaction_id", "vehicle_type", "transaction_time", "pay_fee"]
    complete = F.lit(True)
    for name in needed:
        complete = complete & is_present(df, name)
    return F.when(~complete, K.ISSUE_MISSING)


def score_of(n_issues: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - n_issues * F.lit(0.2))


_TEXT_NUMBERS = ["vehicle_type", "total_weight", "fee_mileage"]


def _scored(df: DataFrame, max_hours: float = 6) -> DataFrame:
    """Scores without parsing. Each rule is a column first: a list is put together row by row
    outside generated code, so only finished labels go into it."""
    rules = [time_issue(df, max_hours), fee_issue(df), vehicle_issue(df), missing_issue(df)]
    names = [f"_rule{i}" for i in range(len(rules))]
    found = df.withColumns(dict(zip(names, rules)))
    n = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    counted = found.withColumns({"issues": F.array_compact(F.array(*names)), "n_issues": n}).drop(*names)
    return counted.withColumn("score", score_of(F.col("n_issues")))


def check_rules(df: DataFrame, max_hours: float = 6) -> DataFrame:
    """Adds the issues found, their number and the score. Thresholds go by the number, which is exact."""
    return drop_parsed(_scored(parse_whole(df, *_TEXT_NUMBERS), max_hours))


def accept(df: DataFrame, max_issues: int = 2) -> DataFrame:
    """Rows with at most two issues, i.e. a score of 0.6 or more (one issue is 0.8)."""
    return df.filter(F.col("n_issues") <= max_issues)


def issue_top(df: DataFrame, k: int = 5) -> DataFrame:
    return top_k(df.select(F.explode("issues").alias("issue")), "issue", k)


def with_date_error(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Flags rows of a known section on a day that is not one of its days. Unknown sections pass.

    The rows are first reduced to distinct pairs of section and day; only the wrong pairs are joined with the rows.
    """
    day = day_label(time_of(df, "transaction_time"))
    pairs = df.select("section_id", day.alias("_date")).filter(F.col("section_id").isNotNull() & F.col("_date").isNotNull()).distinct()
    known = dates.select("section_id").distinct()
    valid = dates.select("section_id", F.col("date").alias("_date")).distinct()
    wrong = pairs.join(known, "section_id", "left_semi").join(valid, ["section_id", "_date"], "left_anti")
    joined = df.withColumn("_date", day).join(wrong.withColumn("_wrong", F.lit(True)), ["section_id", "_date"], "left")
    return joined.withColumn("section_date_error", F.coalesce("_wrong", F.lit(False))).drop("_date", "_wrong")


def section_date_errors(df: DataFrame, dates: DataFrame) -> DataFrame:
    flagged = with_date_error(df, dates)
    return flagged.filter("section_date_error").drop("section_date_error")


def _share_of_fee(fee: Column) -> Column:
    return (fee * F.lit(K.DISCOUNT_SHARE)).try_cast("bigint")


def _typed(df: DataFrame, name: str, c: Column) -> Column:
    return c.cast(df.schema[name].dataType)


def repair(df: DataFrame, gantry_map: DataFrame | None = None) -> DataFrame:
    """Repairs obvious errors: discounts over the fee, times in the wrong order, passenger axles, sections.

    The entrance is moved half an hour to two hours before the transaction, by a span that
    follows from the row itself, so reruns agree. Unknown gantries are flagged, not replaced.
    """
    fee, discount = whole_of(df, "pay_fee"), whole_of(df, "discount_fee")
    start, end = _times(df)
    back = F.lit(1800) + F.pmod(F.xxhash64("gantry_transaction_id", "transaction_time"), F.lit(5401))
    moved = F.timestamp_add("SECOND", -back, end)
    if isinstance(df.schema["entrance_time"].dataType, T.StringType):
        moved = iso_text(moved)
    fixed = df.withColumns(
        {
            "discount_fee": F.when(discount > fee, _typed(df, "discount_fee", _share_of_fee(fee))).otherwise(
                F.col("discount_fee")
            ),
            "entrance_time": F.when(start >= end, moved).otherwise(F.col("entrance_time")),
            "axle_count": F.when(passenger_code(whole_of(df, "vehicle_type")), "2").otherwise(F.col("axle_count")),
        }
    )
    return fixed if gantry_map is None else repair_section(fixed, gantry_map)


def fill_knowledge(df: DataFrame, media_text: bool = False) -> DataFrame:
    """Fills what follows from other fields: the 5 % discount of on-board units, the state of overweight trucks.

    The medium counts as an on-board unit when it is the number 1. Text never equals a number,
    so a text column fills nothing unless ``media_text`` reads the texts as codes.
    """
    obu = F.lit(False)
    if isinstance(df.schema["media_type"].dataType, T.NumericType):
        obu = F.col("media_type") == 1
    elif media_text:
        obu = as_whole(F.col("media_type")) == 1
    none = F.col("discount_fee").cast("string") == "0"
    if isinstance(df.schema["discount_fee"].dataType, T.NumericType):
        none = F.col("discount_fee") == 0
    over = truck_code(whole_of(df, "vehicle_type")) & (whole_of(df, "total_weight") > axle_limit(F.col("axle_count")))
    share = _typed(df, "discount_fee", _share_of_fee(whole_of(df, "pay_fee")))
    return df.withColumns(
        {
            "discount_fee": F.when(obu & none, share).otherwise(F.col("discount_fee")),
            "pass_state": F.when(over, "2").otherwise(F.col("pass_state")),
        }
    )


def recover(df: DataFrame, gantry_map: DataFrame | None = None, media_text: bool = False) -> DataFrame:
    """Enhanced rows that pass: those accepted at once, and rejected ones that pass after repair.

    ``_recovered`` marks the second kind. Scoring, repair and second scoring are one pass.
    """
    parsed = parse_whole(df, *_TEXT_NUMBERS)
    before = _scored(parsed).withColumnRenamed("n_issues", "_n_before").drop("issues", "score")
    after = drop_parsed(_scored(fill_knowledge(repair(before, gantry_map), media_text)))
    kept = after.filter((F.col("_n_before") <= 2) | (F.col("n_issues") <= 2))
    return kept.withColumn("_recovered", F.col("_n_before") > 2).drop("_n_before")


def class_weight(counts: Column, targets: dict, kind: Column) -> Column:
    """min(3, target share / current share) from a struct of truck and total row counts; a class without rows has no share."""
    mine = F.when(kind == K.TRUCK, counts["trucks"]).otherwise(counts["total"] - counts["trucks"])
    target = F.coalesce(lookup(targets, kind), F.lit(0.5))
    return F.least(target / F.nullif(mine / F.nullif(counts["total"], F.lit(0)), F.lit(0.0)), F.lit(3.0))


def class_counts(df: DataFrame) -> DataFrame:
    """One row with the struct ``_counts``: truck and total row counts."""
    truck = F.when(freight_class(F.col("vehicle_type")) == K.TRUCK, 1)
    return df.agg(F.struct(F.count(truck).alias("trucks"), F.count(F.lit(1)).alias("total")).alias("_counts"))


def static_weights(df: DataFrame, targets: dict | None = None) -> DataFrame:
    weight = class_weight(F.col("_counts"), targets or K.CLASS_TARGET, freight_class(F.col("vehicle_type")))
    return df.withColumn("_counts", class_counts(df).scalar()).withColumn("_quality_weight", weight).drop("_counts")


def reinforced(weight: Column, n_issues: Column, rounds: int = 5, lr: float = 0.1) -> Column:
    """Weight after the rounds: up for a score over 0.7, down under 0.5, kept within [0.1, 3] each time."""
    factor = F.when(n_issues <= 1, 1.0 + lr).when(n_issues >= 3, 1.0 - lr).otherwise(1.0)
    for _ in range(rounds):
        weight = F.least(F.lit(3.0), F.greatest(F.lit(0.1), weight * factor))
    return weight


def iterative_weights(
    df: DataFrame, targets: dict | None = None, order: list | None = None, rounds: int = 5, lr: float = 0.1,
    head: float = 0.8,
) -> DataFrame:
    """Re-weights the first part of the rows by class share and score; the rest keeps weight 1.

    The key at the cut is found by counting the order columns; all rows are compared with it where they are.
    Rows that are equal in the order columns are on one side.
    """
    scored = df if "n_issues" in df.columns else check_rules(df)
    scored = scored.withColumn("_first", first_part(scored, order or df.columns, head))
    first, n, kind = F.col("_first"), F.col("n_issues"), freight_class(F.col("vehicle_type"))
    # a weight follows from the class and one of three ranges of issues, so the rounds are gone through once for each
    kinds, issues = (K.TRUCK, K.PASSENGER), (1, 2, 3)
    counted = freeze(class_counts(scored.filter(first)))
    cells = [
        reinforced(class_weight(F.col("_counts"), targets or K.CLASS_TARGET, F.lit(k)), F.lit(i), rounds, lr)
        for k in kinds for i in issues
    ]
    cell = F.when(kind == K.TRUCK, 0).otherwise(len(issues)) + F.when(n <= 1, 0).when(n >= 3, 2).otherwise(1)
    weights = counted.select(F.array(*cells)).scalar()
    return scored.withColumn("_quality_weight", F.when(first, F.get(weights, cell)).otherwise(1.0)).drop("_first")


def by_weight(df: DataFrame) -> DataFrame:
    """All rows, the heaviest first. Rows of one weight, which are many, are ordered by a hash, so that no task gets them all."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.withColumn("_spread", F.xxhash64(*plain)).orderBy(F.desc("_quality_weight"), "_spread").drop("_spread")


def quality_tier(df: DataFrame) -> DataFrame:
    w = F.col("_quality_weight")
    return df.withColumn("tier", F.when(w >= 1.2, "high").when(w >= 0.8, "medium").otherwise("low"))


def tier_summary(df: DataFrame) -> DataFrame:
    """Rows and per cent of each tier."""
    # a row per tier, which the total reads again
    counts = freeze(quality_tier(df).groupBy("tier").agg(F.count(F.lit(1)).alias("cnt")))
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.withColumn("percentage", F.col("cnt") * 100.0 / total)


def verify_vehicle(df: DataFrame) -> DataFrame:
    """Rule-based check of axles and passenger weights; ``_auxiliary_fixed`` names the last column changed."""
    kind, weight = whole_of(df, "vehicle_type"), whole_of(df, "total_weight")
    readable = kind.isNotNull() & weight.isNotNull()
    passenger = readable & kind.between(1, 4)
    expected = F.when(readable & kind.between(11, 16), expected_axles(F.col("vehicle_type"))).when(passenger, "2")
    axle_wrong = F.coalesce(expected.isNotNull() & ~F.col("axle_count").eqNullSafe(expected), F.lit(False))
    weight_wrong = F.coalesce(passenger & ~weight.between(2000, 5000), F.lit(False))
    drawn = F.lit(2500) + F.pmod(F.xxhash64(*map(F.col, df.columns)), F.lit(2001))
    return df.withColumns(
        {
            "axle_count": F.when(axle_wrong, expected).otherwise(F.col("axle_count")),
            "total_weight": F.when(weight_wrong, drawn.cast("string")).otherwise(F.col("total_weight")),
            "_auxiliary_fixed": F.when(weight_wrong, "total_weight").when(axle_wrong, "axle_count"),
        }
    )


def zscore_fix(df: DataFrame, ref: DataFrame, cols=("pay_fee", "fee_mileage", "total_weight"), k: float = 2.0) -> DataFrame:
    """Replaces values more than ``k`` sample deviations from a reference mean by that mean, cut to a whole number.

    ``_corrections`` lists what was changed. The reference is reduced to one row of figures.
    """
    cols = [c for c in cols if c in df.columns and c in ref.columns]
    figures = [
        f.alias(f"{c}_{n}") for c in cols
        for n, f in (("mean", F.avg(number_of(ref, c))), ("std", F.stddev_samp(number_of(ref, c))))
    ]
    rows, stats = df.withColumn("_stats", ref.agg(F.struct(*figures)).scalar()), F.col("_stats")
    changes, log = {}, []
    for c in cols:
        mean = stats[f"{c}_mean"]
        z = F.abs(number_of(df, c) - mean) / (stats[f"{c}_std"] + F.lit(1e-10))
        new = mean.try_cast("bigint").cast("string")
        far = (z > k) & ~F.col(c).cast("string").eqNullSafe(new)
        changes[c] = F.when(far, _typed(df, c, new)).otherwise(F.col(c))
        note = F.struct(
            F.lit(c).alias("field"), F.col(c).cast("string").alias("old"), new.alias("new"), z.alias("z_score")
        )
        log.append(F.when(far, note))
    return rows.withColumns({**changes, "_corrections": F.array_compact(F.array(*log))}).drop("_stats")


def fee_deviation(df: DataFrame) -> DataFrame:
    """Flags fees more than half off a rough estimate; an estimate of 0 flags nothing."""
    fee, mileage = whole_of(df, "pay_fee"), whole_of(df, "fee_mileage")
    factor = F.coalesce(lookup(K.FEE_COEFFICIENT, F.col("vehicle_type")), F.lit(1.0))
    value = mileage / F.lit(1000.0) * F.lit(K.BASE_RATE) * factor * F.lit(100.0)
    expected = value.try_cast("bigint")
    off = F.abs(fee - expected) / F.nullif(expected, F.lit(0).cast("bigint"))
    flag = F.coalesce((fee > 0) & (off > 0.5), F.lit(False))
    return df.withColumns({"_fee_anomaly": flag, "_expected_fee": F.when(flag, expected)})


def legacy_issues(df: DataFrame, max_hours: float = 4) -> Column:
    """Number of issues of the older checks, in which code 2 is the truck."""
    start, end = _times(df)
    time = start.isNull() | end.isNull() | (start >= end) | (_hours(start, end) > max_hours)
    fee = whole_of(df, "discount_fee") > whole_of(df, "pay_fee")
    over = whole_of(df, "total_weight") > axle_limit(F.col("axle_count")) * F.lit(1.5)
    heavy = F.col("vehicle_type").eqNullSafe(F.lit("2")) & over
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in (time, fee, heavy)), F.lit(0))


def _legacy_twentieths(df: DataFrame, max_hours: float) -> Column:
    """Overall score in twentieths, so thresholds compare whole numbers."""
    light = F.col("vehicle_type").eqNullSafe(F.lit("1")) & F.col("axle_count").eqNullSafe(F.lit("2"))
    paid = F.coalesce(whole_of(df, "pay_fee") > 0, F.lit(False))
    fidelity = F.greatest(F.lit(0), F.lit(10) - 2 * legacy_issues(df, max_hours))
    return fidelity + 5 * (light.cast("int") + paid.cast("int"))


def legacy_quality(df: DataFrame, max_hours: float = 4) -> DataFrame:
    """Older score (half fidelity, half consistency), with one repair for rows under 0.6.

    A repaired row is kept from 0.48 on. The repair covers discounts over the fee and times
    in the wrong order, which are set back by one to two hours.
    """
    df = parse_whole(df, *_TEXT_NUMBERS)
    scored = df.withColumn("_first", _legacy_twentieths(df, max_hours))
    low = F.col("_first") < 12
    fee, discount = whole_of(df, "pay_fee"), whole_of(df, "discount_fee")
    start, end = _times(df)
    back = F.lit(3600) + F.pmod(F.xxhash64("gantry_transaction_id", "transaction_time"), F.lit(3601))
    moved = F.timestamp_add("SECOND", -back, end)
    if isinstance(df.schema["entrance_time"].dataType, T.StringType):
        moved = iso_text(moved)
    less = _typed(df, "discount_fee", _share_of_fee(fee))
    fixed = scored.withColumns(
        {
            "discount_fee": F.when(low & (discount > fee), less).otherwise(F.col("discount_fee")),
            "entrance_time": F.when(low & (start >= end), moved).otherwise(F.col("entrance_time")),
        }
    )
    again = fixed.withColumn("_second", _legacy_twentieths(fixed, max_hours))
    # 0.48 is 9.6 twentieths, so 10 whole ones are needed
    return drop_parsed(again).withColumns(
        {
            "overall": F.when(low, F.col("_second")).otherwise(F.col("_first")) / F.lit(20.0),
            "repaired": low,
            "kept": ~low | (F.col("_second") >= 10),
        }
    ).drop("_first", "_second")


def valid_only(df: DataFrame) -> DataFrame:
    """Rows whose times are not in the wrong order and whose discount is within the fee; unreadable times pass."""
    start, end = _times(df)
    late = F.coalesce(start >= end, F.lit(False))
    over = F.coalesce(whole_of(df, "discount_fee") > whole_of(df, "pay_fee"), F.lit(False))
    return df.filter(~late & ~over)
