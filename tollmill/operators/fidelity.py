"""How closely one table of gantry transactions follows another, and task scores of a single table.

Both tables are counted in one aggregate with a marker of the side, so distributions are
aligned by grouping instead of a join of two results. Overall figures are one-row frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import is_present, number_of, seconds_between, time_of, whole_of
from tollmill.functions.vehicles import axle_limit, expected_fee, time_period
from tollmill.operators.ordering import top_n_per_group
from tollmill.operators.profiling import diversity_counts, fee_mileage_pairs, unpivot
from tollmill.operators.quality import check_rules, legacy_issues, with_date_error

DISTRIBUTION_FIELDS = ["vehicle_type", "section_id", "media_type"]


def _two_sided(a: DataFrame, b: DataFrame, values) -> DataFrame:
    """Counts per (field, value) on both sides. ``values`` maps a frame to its {field: expression}."""
    left = unpivot(a, values(a)).filter(F.col("value").isNotNull())
    right = unpivot(b, values(b)).filter(F.col("value").isNotNull())
    n = F.count(F.lit(1))
    counted = left.groupBy("field", "value").agg(n.alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        right.groupBy("field", "value").agg(F.lit(0).cast("bigint").alias("a"), n.alias("b"))
    )
    return counted.groupBy("field", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _probabilities(counts: DataFrame) -> DataFrame:
    """p and q next to the counts; a field that is empty on one side drops out."""
    totals = counts.groupBy("field").agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"))
    totals = totals.filter((F.col("_ta") > 0) & (F.col("_tb") > 0))
    joined = counts.join(totals, "field")
    return joined.withColumns({"p": F.col("a") / F.col("_ta"), "q": F.col("b") / F.col("_tb")}).drop("_ta", "_tb")


def _js(p: Column, q: Column) -> Column:
    mid = (p + q) / 2
    return (F.sum(F.when(p > 0, p * F.log(p / mid))) + F.sum(F.when(q > 0, q * F.log(q / mid)))) / 2


def _similar(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + x)


def _js_table(counts: DataFrame) -> DataFrame:
    by_field = _probabilities(counts).groupBy("field")
    table = by_field.agg(_js(F.col("p"), F.col("q")).alias("js_divergence"))
    return table.withColumn("similarity", _similar(F.col("js_divergence")))


def js_divergence(a: DataFrame, b: DataFrame, cols=None) -> DataFrame:
    """Jensen-Shannon divergence (natural log) and similarity per column; empty values do not count."""
    cols = cols or DISTRIBUTION_FIELDS
    return _js_table(_two_sided(a, b, lambda df: {c: F.when(is_present(df, c), F.col(c)) for c in cols}))


def kl_js_smoothed(a: DataFrame, b: DataFrame, cols=None) -> DataFrame:
    """Smoothed similarity per column and its mean as ``overall``. An absent value counts as 1e-10.

    Empty texts are values here; only NULL is not.
    """
    cols = [c for c in (cols or K.CATEGORICAL_FIELDS) if c in a.columns and c in b.columns]
    probs = _probabilities(_two_sided(a, b, lambda df: {c: F.col(c) for c in cols}))
    mid = (F.col("p") + F.col("q")) / 2

    def kl(x: str) -> Column:
        smooth = F.when(F.col(x) > 0, F.col(x)).otherwise(1e-10)
        return F.sum(smooth * F.log(smooth / mid))

    fields = probs.groupBy("field").agg(((kl("p") + kl("q")) / 2).alias("js_divergence"))
    fields = fields.withColumn("similarity", _similar(F.col("js_divergence")))
    overall = fields.agg(F.avg("js_divergence").alias("js_divergence"), F.avg("similarity").alias("similarity"))
    return fields.unionByName(overall.withColumn("field", F.lit("overall")))


def _amount(df: DataFrame, name: str) -> Column:
    """Whole number of a present value. The number 0 is absent, the text '0' is not."""
    return F.when(is_present(df, name), number_of(df, name).try_cast("bigint"))


def numeric_moments(df: DataFrame, cols) -> DataFrame:
    pairs = unpivot(df, {c: _amount(df, c) for c in cols}, "double").filter(F.col("value").isNotNull())
    return pairs.groupBy("field").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")
    )


def numeric_similarity(a: DataFrame, b: DataFrame, cols=("pay_fee", "fee_mileage")) -> DataFrame:
    """Similarity of mean and standard deviation per column; b is the reference."""
    left = numeric_moments(a, cols).select("field", F.col("mean").alias("mean_a"), F.col("std").alias("std_a"))
    right = numeric_moments(b, cols).select("field", F.col("mean").alias("mean_b"), F.col("std").alias("std_b"))

    def near(x: str) -> Column:
        return _similar(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) / (F.col(f"{x}_b") + F.lit(1e-10)))

    joined = left.join(right, "field").withColumns({"mean_similarity": near("mean"), "std_similarity": near("std")})
    return joined.withColumn("similarity", (F.col("mean_similarity") + F.col("std_similarity")) / 2)


def temporal_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Divergence and similarity over the four periods of the day."""
    counts = _two_sided(a, b, lambda df: {"time_period": time_period(time_of(df, "transaction_time"))})
    return _js_table(counts)


def correlation_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fee-mileage correlation of both sides per class, their similarity and the rows it weighs."""
    r = F.corr(F.col("fee").cast("double"), F.col("mileage").cast("double"))

    def side(df: DataFrame, tag: str) -> DataFrame:
        stats = fee_mileage_pairs(df).groupBy("vehicle_class").agg(
            r.alias(f"corr_{tag}"), F.count(F.lit(1)).alias(f"n_{tag}")
        )
        return stats.filter(F.col(f"n_{tag}") >= 2)

    joined = side(a, "a").join(side(b, "b"), "vehicle_class")
    gap = F.abs(F.nanvl("corr_a", F.lit(None)) - F.nanvl("corr_b", F.lit(None)))
    return joined.withColumn("similarity", _similar(gap))


def correlation_score(table: DataFrame) -> DataFrame:
    usable = table.filter(F.col("similarity").isNotNull())
    mean = F.sum(F.col("similarity") * F.col("n_a")) / F.sum("n_a")
    return usable.agg(F.coalesce(mean, F.lit(0.0)).alias("score"))


def _score(table: DataFrame) -> Column:
    return table.agg(F.coalesce(F.avg("similarity"), F.lit(0.0))).scalar()


def _one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def benchmark_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """The four similarities of a with the reference b, their weighted mean and a verdict."""
    row = _one_row(a).select(
        _score(js_divergence(a, b)).alias("distribution_similarity"),
        _score(numeric_similarity(a, b)).alias("statistical_similarity"),
        _score(temporal_similarity(a, b)).alias("temporal_similarity"),
        correlation_score(correlation_similarity(a, b)).scalar().alias("correlation_similarity"),
    )
    overall = (
        F.col("distribution_similarity") * 0.35 + F.col("statistical_similarity") * 0.25
        + F.col("temporal_similarity") * 0.20 + F.col("correlation_similarity") * 0.20
    )
    verdict = F.when(F.col("overall_similarity") >= 0.95, "优秀").when(F.col("overall_similarity") >= 0.85, "良好")
    return row.withColumn("overall_similarity", overall).withColumn("verdict", verdict.otherwise("需改进"))


def constraint_check(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows with at most one issue and no wrong section date, out of all rows."""
    flagged = with_date_error(check_rules(df), dates)
    valid = (F.col("n_issues") <= 1) & ~F.col("section_date_error")
    return flagged.agg(
        F.count(F.when(valid, 1)).alias("valid_count"), F.count(F.lit(1)).alias("total_count"),
        F.count(F.when(F.col("section_date_error"), 1)).alias("section_date_errors"),
    ).withColumn("constraint_score", F.coalesce(F.try_divide("valid_count", "total_count"), F.lit(0.0)))


def faithfulness(df: DataFrame, dates: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Share of valid rows; with a reference table, half of that and half of the similarity."""
    checks = constraint_check(df, dates)
    if ref is None:
        return checks.withColumn("score", F.col("constraint_score"))
    near = benchmark_similarity(df, ref).select("overall_similarity").scalar()
    return checks.withColumn("score", F.col("constraint_score") * 0.5 + near * 0.5)


def diversity(df: DataFrame) -> DataFrame:
    def part(col: str, full: int, weight: float) -> Column:
        return F.least(F.col(col) / F.lit(float(full)), F.lit(1.0)) * F.lit(weight)

    score = (
        part("n_vehicle_type", 10, 0.2) + part("n_gantry_id", 30, 0.25) + part("n_section_id", 8, 0.2)
        + part("n_time_period", 4, 0.15) + F.col("uniqueness") * 0.2
    )
    return diversity_counts(df).withColumn("score", score)


def direct_score(df: DataFrame, dates: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """0.6 faithfulness and 0.4 diversity."""
    row = _one_row(df).select(
        faithfulness(df, dates, ref).select("score").scalar().alias("faithfulness"),
        diversity(df).select("score").scalar().alias("diversity"),
    )
    return row.withColumn("overall_score", F.col("faithfulness") * 0.6 + F.col("diversity") * 0.4)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _named(counters: dict[str, Column], prefix: str = "") -> list[Column]:
    return [c.alias(prefix + name) for name, c in counters.items()]


def _anomaly_counters(df: DataFrame) -> dict[str, Column]:
    marked = F.col("pass_state").eqNullSafe(F.lit("2"))
    over = whole_of(df, "total_weight") > axle_limit(F.col("axle_count"))
    return {
        "total_samples": F.count(F.lit(1)), "anomaly_samples": F.count(F.when(marked, 1)),
        "true_positives": F.count(F.when(marked & over, 1)),
    }


def task_anomaly(df: DataFrame) -> DataFrame:
    """Share of state-2 rows that really are over their limit."""
    return df.agg(*_named(_anomaly_counters(df))).withColumn("precision", _ratio("true_positives", "anomaly_samples"))


def _fee_class() -> Column:
    kind = F.coalesce(F.col("vehicle_type").isin(*K.PASSENGER_CODES), F.lit(False))
    return F.when(kind, "passenger").otherwise("truck")


def _fee_counters(df: DataFrame) -> dict[str, Column]:
    fee, mileage = whole_of(df, "pay_fee"), whole_of(df, "fee_mileage")
    readable = fee.isNotNull() & mileage.isNotNull()
    usable = readable & (mileage != 0) & (fee != 0)
    ratio = F.when(usable, fee / F.nullif(mileage, F.lit(0).cast("bigint")))
    rough = F.when((fee > 0) & (mileage > 0), F.least(F.abs(ratio - 0.11) / 0.11, F.lit(2.0)))
    return {
        "rows": F.count(F.lit(1)), "n": F.count(ratio), "mean_ratio": F.avg(ratio), "std_ratio": F.stddev_pop(ratio),
        "zero_mileage": F.count(F.when(readable & (mileage == 0), 1)),
        "zero_fee": F.count(F.when(readable & (mileage != 0) & (fee == 0), 1)), "rough_sum": F.sum(rough), "rough_n": F.count(rough),
    }


def _fee_accuracy() -> Column:
    """From the fee counters of each class."""
    cv = F.when(F.col("mean_ratio") > 0, F.col("std_ratio") / F.col("mean_ratio")).otherwise(0.0)
    score = F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), F.lit(1.0) - cv))
    mae = F.coalesce(F.try_divide(F.sum("rough_sum"), F.sum("rough_n")), F.lit(2.0))
    return F.coalesce(F.avg(score), F.greatest(F.lit(0.0), F.lit(1.0) - mae / 2))


def task_fee(df: DataFrame) -> DataFrame:
    """1 - CV of fee per metre, per class and averaged. Without a class of two rows, distance from 0.11."""
    classes = df.groupBy(_fee_class().alias("vehicle_class")).agg(*_named(_fee_counters(df)))
    return classes.agg(
        F.sum("n").alias("samples_evaluated"), (F.sum("rows") - F.sum("n")).alias("samples_failed"),
        F.sum("zero_mileage").alias("zero_mileage_count"), F.sum("zero_fee").alias("zero_fee_count"), _fee_accuracy().alias("accuracy"),
    )


def task_fee_formula(df: DataFrame) -> DataFrame:
    """1 - mean relative error against the tariff; a tariff of 0 counts as no error."""
    fee, mileage = whole_of(df, "pay_fee"), whole_of(df, "fee_mileage")
    expected = expected_fee(mileage, F.col("vehicle_type"))
    off = F.abs(fee - expected) / F.nullif(expected, F.lit(0).cast("bigint"))
    error = F.when(fee.isNotNull() & mileage.isNotNull(), F.when(expected > 0, off).otherwise(0.0))
    return df.agg(
        F.count(error).alias("samples_evaluated"), F.coalesce(F.avg(error), F.lit(1.0)).alias("mean_absolute_error")
    ).withColumn("accuracy", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("mean_absolute_error")))


def _vehicle_counters(df: DataFrame) -> dict[str, Column]:
    kind, weight = whole_of(df, "vehicle_type"), whole_of(df, "total_weight")
    readable = kind.isNotNull() & weight.isNotNull()
    light = kind.between(1, 4) & F.col("axle_count").eqNullSafe(F.lit("2")) & weight.between(2000, 5000)
    heavy = kind.between(11, 16) & (weight <= axle_limit(F.col("axle_count")) * F.lit(1.2))
    return {"total_samples": F.count(F.when(readable, 1)), "correct_predictions": F.count(F.when(readable & (light | heavy), 1))}


def task_vehicle(df: DataFrame) -> DataFrame:
    """Passenger cars with two axles and 2-5 t, trucks within 1.2 times their limit."""
    return df.agg(*_named(_vehicle_counters(df))).withColumn("accuracy", _ratio("correct_predictions", "total_samples"))


def _trip_seconds(df: DataFrame) -> tuple[Column, Column]:
    """Seconds of a trip in the right order, and whether both times are known."""
    start, end = time_of(df, "entrance_time"), time_of(df, "transaction_time")
    return F.when(start < end, seconds_between(start, end)), start.isNotNull() & end.isNotNull()


def _time_counters(df: DataFrame) -> dict[str, Column]:
    seconds, known = _trip_seconds(df)
    return {"total_samples": F.count(F.when(known, 1)), "valid_samples": F.count(F.when((seconds / 3600.0).between(0.5, 6), 1))}


def task_time(df: DataFrame) -> DataFrame:
    """Share of trips of half an hour to six hours, and the mean hours of trips in the right order."""
    seconds, _ = _trip_seconds(df)
    mean = F.coalesce(F.avg(seconds) / 3600.0, F.lit(0.0))
    return df.agg(*_named(_time_counters(df)), mean.alias("avg_time_diff_hours")).withColumn("accuracy", _ratio("valid_samples", "total_samples"))


def task_overall(df: DataFrame) -> DataFrame:
    """Mean of the four task scores, from one pass over the rows."""
    counters = {"a_": _anomaly_counters(df), "v_": _vehicle_counters(df), "t_": _time_counters(df)}
    classes = df.groupBy(_fee_class().alias("vehicle_class")).agg(
        *_named(_fee_counters(df)), *[c for prefix, group in counters.items() for c in _named(group, prefix)]
    )
    sums = [F.sum(prefix + name).alias(prefix + name) for prefix, group in counters.items() for name in group]
    row = classes.agg(_fee_accuracy().alias("fee"), *sums).select(
        _ratio("a_true_positives", "a_anomaly_samples").alias("anomaly_detection"), F.col("fee").alias("fee_prediction"),
        _ratio("v_correct_predictions", "v_total_samples").alias("vehicle_classification"),
        _ratio("t_valid_samples", "t_total_samples").alias("time_consistency"),
    )
    tasks = [F.col(c) for c in row.columns]
    return row.withColumn("score", reduce(lambda x, y: x + y, tasks) / F.lit(4.0))


def legacy_diversity(df: DataFrame, max_hours: float = 4) -> DataFrame:
    """Older diversity and the share of rows without any older issue."""
    counts = diversity_counts(df)
    fidelity = df.agg(F.avg(F.when(legacy_issues(df, max_hours) == 0, 1.0).otherwise(0.0))).scalar()
    spread = F.col("n_vehicle_type") + F.col("n_gantry_id") / 2 + F.col("n_section_id") / 2
    capped = F.least(F.lit(1.0), spread / (F.least(F.col("n_rows"), F.lit(10)) * 2))
    return counts.select(
        F.when(F.col("n_rows") < 2, 1.0).otherwise(capped).alias("diversity"), fidelity.alias("fidelity")
    )


def compare_top_values(a: DataFrame, b: DataFrame, cols=None, k: int = 3) -> DataFrame:
    """The k most frequent values of each column on both sides, by rank, with the column's similarity."""
    cols = [c for c in (cols or K.CATEGORICAL_FIELDS) if c in a.columns and c in b.columns]
    probs = _probabilities(_two_sided(a, b, lambda df: {c: F.col(c) for c in cols}))

    def best(p: str, tag: str) -> DataFrame:
        rows = probs.filter(F.col(p) > 0)
        ranked = top_n_per_group(rows, "field", [F.desc(p), F.asc("value")], k, rank="rank")
        return ranked.select("field", "rank", F.col("value").alias(f"value_{tag}"), F.col(p).alias(f"prob_{tag}"))

    near = kl_js_smoothed(a, b, cols).select("field", "similarity")
    return best("p", "a").join(best("q", "b"), ["field", "rank"], "full").join(near, "field")


def major_values(probs: DataFrame, least: float = 0.01) -> DataFrame:
    """Values with a probability over one per cent."""
    return probs.filter(F.col("prob") > least).orderBy("field", F.desc("prob"), "value")


def peak_hours_of(profile: DataFrame, k: int = 5) -> DataFrame:
    """The busiest hours of each time column of a date-time profile."""
    return top_n_per_group(profile.filter(F.col("unit") == "hour"), "field", [F.desc("prob"), F.asc("value")], k)
