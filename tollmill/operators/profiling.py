"""Value frequencies, distributions and table profiles.

All columns are profiled in one scan: the row is unpivoted into (field, value) pairs,
which are counted before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import as_number, day_label, is_present, number_of, safe_int, shown_ratio, time_of
from tollmill.functions.vehicles import freight_class, time_period
from tollmill.operators.ordering import running_sum, chunk_of, with_share
from tollmill.session import freeze


def unpivot(df: DataFrame, exprs: dict[str, Column], kind: str = "string") -> DataFrame:
    """(field, value) pairs of the given expressions, in one pass."""
    wide = df.select(*[e.cast(kind).alias(n) for n, e in exprs.items()])
    return wide.unpivot([], list(exprs), "field", "value")


def value_frequency(df: DataFrame, cols) -> DataFrame:
    """Count per value of each column; NULL is not a value."""
    pairs = unpivot(df, {c: F.col(c) for c in cols}).filter(F.col("value").isNotNull())
    return pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt"))


def frequency_report(df: DataFrame, cols) -> DataFrame:
    """Value frequencies in report order: by column, most frequent first."""
    return value_frequency(df, cols).orderBy("field", F.desc("cnt"), "value")


def min_max(df: DataFrame, cols) -> DataFrame:
    """Smallest and largest value per column, as text, from one aggregate."""
    one = df.agg(*[f(c).cast("string").alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)])
    rows = [
        F.struct(F.lit(c).alias("field"), F.col(f"min_{c}").alias("min_value"), F.col(f"max_{c}").alias("max_value"))
        for c in cols
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def joint_frequency(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = rows.groupBy(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
    return counts.agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.length(a), a, F.desc("cnt"), b)


def joint_report(df: DataFrame, a: str, b: str) -> DataFrame:
    """Lines of the joint frequency report: the total, a heading and one line per pair."""
    counts = joint_frequency(df, a, b)

    def placed(part: int, n, text, cnt, other, line) -> list[Column]:
        key = F.struct(
            F.lit(part).alias("part"), n.alias("n"), text.alias("text"), (-cnt).alias("cnt"), other.alias("other")
        )
        return [key.alias("key"), line.alias("value")]

    none, blank = F.lit(0), F.lit("")
    total = counts.agg(F.sum("cnt").alias("total"))
    lines = placed(0, none, blank, none.cast("bigint"), blank, F.concat(F.lit("total_records: "), "total"))
    heading = placed(1, none, blank, none.cast("bigint"), blank, F.lit(f"{a},{b},count"))
    body = placed(2, F.length(a), F.col(a), F.col("cnt"), F.col(b), F.concat_ws(",", a, b, F.col("cnt").cast("string")))
    rows = total.select(*lines).unionByName(total.select(*heading)).unionByName(counts.select(*body))
    return rows.orderBy("key").select("value")


def conditional_probability(df: DataFrame, a: str, b: str) -> DataFrame:
    """P(a, b) and P(b | a) for every pair that occurs."""
    counts = joint_frequency(df, a, b)
    return with_share(with_share(counts, share="joint_prob"), over=a, share="cond_prob")


def fd_violations(df: DataFrame, key: str, dep: str) -> DataFrame:
    """Keys that come with more than one value of the dependent column."""
    pairs = df.filter(F.col(key).isNotNull() & F.col(dep).isNotNull()).select(key, dep).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_values")).filter(F.col("n_values") > 1)


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    rows = df.filter(F.col(ts).isNotNull())
    return rows.groupBy(day_label(F.col(ts)).alias("date")).agg(F.count(F.lit(1)).alias("cnt")).orderBy("date")


def date_span(df: DataFrame, ts: str) -> DataFrame:
    """Records with a time, distinct days, first and last moment."""
    daily = df.filter(F.col(ts).isNotNull()).groupBy(day_label(F.col(ts)).alias("_day"))
    parts = daily.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count(F.lit(1)).alias("distinct_days"),
        F.min("lo").alias("earliest"), F.max("hi").alias("latest"),
    )


def section_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("section_id", "section_name").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "section_id")


def profile_categorical(df: DataFrame, cols=None) -> DataFrame:
    """Count and probability per value."""
    cols = [c for c in (cols or K.CATEGORICAL_FIELDS) if c in df.columns]
    return with_share(value_frequency(df, cols), over="field", share="prob")


def value_counts(numbers: DataFrame) -> DataFrame:
    """Rows per (field, value), written once: what moments and percentiles need of a table, in one scan."""
    counts = numbers.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return freeze(counts)


def exact_percentiles(numbers: DataFrame, probs: list[float], counts: DataFrame | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation of (field, value) pairs.

    The rows are counted per value; running counts over ranges of (field, value) then tell which value holds a rank. The
    ranges have about equal numbers of values, so no field is ordered in one task, however its values are spread.
    """
    counts = value_counts(numbers) if counts is None else counts
    summed = running_sum(counts, ["field", "value"], "n", "_end").withColumn("_start", F.col("_end") - F.col("n"))
    ends = summed.groupBy("field").agg(F.min("_start").alias("base"), F.sum("n").alias("total"))
    want = [F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for p in probs]
    asked = ends.select("field", "base", F.explode(F.array(*want)).alias("w")).select("field", "base", "w.p", "w.at")
    # one row per field and percentile
    near = summed.join(F.broadcast(asked), "field")
    holds = lambda rank: (F.col("base") + rank >= F.col("_start")) & (F.col("base") + rank < F.col("_end"))
    low, high = holds(F.floor("at")), holds(F.ceil("at"))
    found = near.filter(low | high).groupBy("field", "p", "at").agg(
        F.max(F.when(low, F.col("value"))).alias("a"), F.max(F.when(high, F.col("value"))).alias("b")
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.select("field", "p", value.alias("percentile"))


def _numbers(df: DataFrame, cols) -> DataFrame:
    return unpivot(df, {c: number_of(df, c) for c in cols}, "double").filter(F.col("value").isNotNull())


def profile_numeric(df: DataFrame, cols=None, probs=(0.25, 0.5, 0.75), sample_std: bool = False) -> DataFrame:
    """Count, min, max, mean, standard deviation and quartiles; unreadable values are skipped."""
    cols = [c for c in (cols or K.NUMERIC_FIELDS) if c in df.columns]
    numbers = _numbers(df, cols)
    counts = value_counts(numbers)
    means = counts.groupBy("field").agg(
        F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )
    off = F.col("value") - F.col("_mean")
    # one row per field
    apart = counts.join(F.broadcast(means.select("field", F.col("mean").alias("_mean"))), "field").groupBy("field").agg(
        F.sqrt(F.try_divide(F.sum(off * off * F.col("n")), F.sum("n") - F.lit(1 if sample_std else 0))).alias("std")
    )
    moments = means.join(apart, "field")
    named = {p: f"p{round(p * 100)}" for p in probs}
    parts = exact_percentiles(numbers, list(probs), counts).groupBy("field").agg(
        *[F.max(F.when(F.col("p") == p, F.col("percentile"))).alias(name) for p, name in named.items()]
    )
    return moments.join(parts, "field")


def profile_datetime(df: DataFrame, cols=None) -> DataFrame:
    """Share of each hour and weekday (Monday is 0) per time column."""
    cols = [c for c in (cols or K.DATETIME_FIELDS) if c in df.columns]
    parts = {}
    for c in cols:
        ts = time_of(df, c)
        parts[f"{c}/hour"] = F.hour(ts)
        parts[f"{c}/weekday"] = F.weekday(ts)
    counts = (
        unpivot(df, parts, "int").filter(F.col("value").isNotNull())
        .groupBy(
            F.split_part("field", F.lit("/"), F.lit(1)).alias("field"),
            F.split_part("field", F.lit("/"), F.lit(2)).alias("unit"), "value",
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return with_share(counts, over=["field", "unit"], share="prob")


def class_period_mix(df: DataFrame) -> DataFrame:
    """Share of vehicle classes (codes 0-5 are passenger) and of periods (night is 0-6 o'clock)."""
    hour = F.hour(time_of(df, "transaction_time"))
    vehicle = F.when(F.col("vehicle_type").isin("0", "1", "2", "3", "4", "5"), K.PASSENGER).otherwise(K.TRUCK)
    period = (
        F.when(hour.between(7, 8), K.MORNING_PEAK).when(hour.between(17, 18), K.EVENING_PEAK)
        .when(hour < 6, K.NIGHT).when(hour.isNotNull(), K.OFF_PEAK)
    )
    pairs = unpivot(df, {"vehicle": F.when(is_present(df, "vehicle_type"), vehicle), "time": period})
    counts = pairs.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy(F.col("field").alias("_field")).agg(F.sum("cnt").alias("_total"))
    shared = counts.join(totals, F.col("field") == F.col("_field"))
    return shared.withColumn("share", shown_ratio(F.col("cnt"), F.col("_total"), 2)).drop("_field", "_total")


def fee_mileage_pairs(df: DataFrame) -> DataFrame:
    """Positive fee and mileage with the class (codes 1-5 are passenger, all others trucks)."""
    kind = F.when(F.coalesce(F.col("vehicle_type").isin("1", "2", "3", "4", "5"), F.lit(False)), "passenger")
    return df.select(
        kind.otherwise("truck").alias("vehicle_class"), safe_int(F.col("pay_fee")).alias("fee"),
        safe_int(F.col("fee_mileage")).alias("mileage"),
    ).filter((F.col("fee") > 0) & (F.col("mileage") > 0))


def _spread(c: str) -> list[Column]:
    x = F.col(c)
    return [
        F.avg(x).try_cast("bigint").alias(f"{c}_mean"), F.stddev_pop(x).try_cast("bigint").alias(f"{c}_std"),
        F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
    ]


def fee_mileage_stats(df: DataFrame) -> DataFrame:
    """Fee and mileage figures (cut to whole numbers) with their correlation, per class and overall.

    A class needs two rows; the overall line needs one.
    """
    pairs = fee_mileage_pairs(df)
    r = F.corr(F.col("fee").cast("double"), F.col("mileage").cast("double"))
    stats = pairs.rollup("vehicle_class").agg(
        *_spread("fee"), *_spread("mileage"), F.nanvl(r, F.lit(0.0)).alias("correlation"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    stats = stats.filter((F.col("sample_count") >= 2) | F.col("vehicle_class").isNull())
    return stats.filter(F.col("sample_count") > 0).withColumns(
        {
            "vehicle_class": F.coalesce("vehicle_class", F.lit("overall")),
            "correlation": F.coalesce("correlation", F.lit(0.0)),
        }
    )


def fee_mileage_overall(df: DataFrame) -> DataFrame:
    """Overall variant: fee and mileage are each taken where present, independently of each other."""
    fee = F.when(is_present(df, "pay_fee"), as_number(F.col("pay_fee")).try_cast("bigint"))
    mileage = F.when(is_present(df, "fee_mileage"), as_number(F.col("fee_mileage")).try_cast("bigint"))
    return df.select(fee.alias("fee"), mileage.alias("mileage")).agg(*_spread("fee"), *_spread("mileage"))


def section_dates(df: DataFrame, presets: DataFrame | None = None, ts: str = "transaction_time") -> DataFrame:
    """Distinct (section, date) pairs, with preset pairs added for sections that occur."""
    when = time_of(df, ts)
    seen = df.filter(is_present(df, "section_id") & when.isNotNull()).select("section_id", day_label(when).alias("date"))
    seen = seen.distinct()
    if presets is None:
        return seen
    extra = presets.select("section_id", "date").join(seen.select("section_id").distinct(), "section_id", "left_semi")
    return seen.unionByName(extra).distinct()


def section_date_ranges(dates: DataFrame) -> DataFrame:
    """Number of dates, first and last date per section. ISO dates sort as text."""
    return dates.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def diversity_counts(df: DataFrame) -> DataFrame:
    """Distinct vehicle types, gantries, sections and periods, rows, and the share of distinct ids.

    NULL counts as one value of its own. Each column is reduced to its distinct values in
    the same pass, so only distinct values are shuffled.
    """
    period = F.coalesce(time_period(time_of(df, "transaction_time")), F.lit(K.UNKNOWN))
    cols = ["vehicle_type", "gantry_id", "section_id", "gantry_transaction_id"]
    pairs = unpivot(df, {**{c: F.col(c) for c in cols}, "time_period": period})
    sizes = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(
        F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")
    )
    return sizes.agg(
        *[F.max(F.when(F.col("field") == c, F.col("values"))).alias(f"n_{c}") for c in [*cols, "time_period"]],
        F.max("rows").alias("n_rows"),
    ).withColumn("uniqueness", F.col("n_gantry_transaction_id") / F.col("n_rows"))


def coverage(df: DataFrame, targets, label: Column | None = None) -> DataFrame:
    """Share of the target values that occur. The default label is the two-way vehicle class."""
    value = freight_class(F.col("vehicle_type")) if label is None else label
    wanted = list(dict.fromkeys(targets))
    present = df.select(value.alias("v")).filter(F.col("v").isin(*wanted)).distinct()
    return present.agg((F.count(F.lit(1)) / F.lit(len(wanted))).alias("coverage"))


def summarize(df: DataFrame, listed: int | None = None) -> DataFrame:
    """Rows, tolls due and paid, mean toll, distinct sections and their list (its first ``listed`` if given)."""
    sections = df.filter(is_present(df, "section_id")).select("section_id").distinct()
    first = sections if listed is None else sections.orderBy("section_id").limit(listed)
    names = first.agg(F.array_sort(F.collect_list("section_id"))).scalar()
    n_sections = sections.agg(F.count(F.lit(1))).scalar()
    toll, real = F.sum("toll_money").cast("double"), F.sum("real_money").cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(toll, F.lit(0.0)).alias("total_toll_fee"),
        F.coalesce(toll / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("average_toll_fee"),
        F.coalesce(real, F.lit(0.0)).alias("total_real_money"), n_sections.alias("unique_sections"),
        names.alias("sections"),
    )


def summarize_flow(counts: DataFrame) -> DataFrame:
    """Total and mean of a flow report."""
    return counts.agg(
        F.sum("truck_count").alias("total_truck_count"), F.avg("truck_count").alias("average_truck_count")
    )


def export_summary(df: DataFrame) -> DataFrame:
    """Rows, number of vehicle types and sections, and the date range of an export."""
    ts = time_of(df, "transaction_time")
    kinds = df.groupBy("vehicle_type", "section_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi")
    )
    return kinds.agg(
        F.sum("n").alias("total_count"), F.countDistinct("vehicle_type").alias("vehicle_types"),
        F.countDistinct("section_id").alias("section_ids"), day_label(F.min("lo")).alias("date_min"),
        day_label(F.max("hi")).alias("date_max"),
    )


def chunk_stats(
    df: DataFrame, order: list, size: int = 50, target: float | None = None, fee: str = "pay_fee",
    mileage: str | None = "fee_mileage",
) -> DataFrame:
    """Fee figures of every chunk of ``size`` rows, cut to whole numbers.

    With a target mean, chunks of at least five rows that lie more than a fifth off are marked.
    """
    chunks = chunk_of(df, order, size)
    x = as_number(F.col(fee))
    figures = [
        F.avg(x).try_cast("bigint").alias("fee_mean"), F.stddev_pop(x).try_cast("bigint").alias("fee_std"),
        F.min(x).try_cast("bigint").alias("fee_min"), F.max(x).try_cast("bigint").alias("fee_max"),
    ]
    if mileage and mileage in df.columns:
        m = as_number(F.col(mileage))
        figures += [
            F.coalesce(F.avg(m).try_cast("bigint"), F.lit(0)).alias("mileage_mean"),
            F.coalesce(F.stddev_pop(m).try_cast("bigint"), F.lit(0)).alias("mileage_std"),
        ]
    stats = chunks.groupBy("chunk").agg(*figures, F.count(F.lit(1)).alias("count"))
    if target is None:
        return stats
    off = F.abs(F.col("fee_mean") - F.lit(float(target))) / F.lit(float(target)) > 0.2
    hint = F.when(F.col("fee_mean") < target, "low").otherwise("high")
    return stats.withColumn("hint", F.when((F.col("count") >= 5) & off, hint))


def correction_rate(df: DataFrame, corrected: Column | None = None, anomalous: Column | None = None) -> DataFrame:
    """Corrected and anomalous rows, and the share of corrected ones."""
    fixed = F.size("_corrections") > 0 if corrected is None else corrected
    odd = F.lit(False) if anomalous is None else anomalous
    return df.agg(
        F.count(F.lit(1)).alias("checked"), F.count(F.when(fixed, 1)).alias("corrected"),
        F.count(F.when(odd, 1)).alias("anomalous"),
    ).withColumn("correction_rate", F.coalesce(F.try_divide("corrected", "checked"), F.lit(0.0)))
