"""Traffic, revenue and truck reports.

Averages of money are an exact decimal sum over a count, so they do not depend on the
order in which partitions arrive. Shown shares and means are rounded from whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollmill.functions import constants as K
from tollmill.functions.cleaning import day_label, hour_label, minutes_between, shown_ratio
from tollmill.functions.text import mask_id
from tollmill.operators.filters import non_blank, scoped, truck, trucks_only, usable_numeric, where_opt
from tollmill.operators.ordering import top_n_per_group, with_share
from tollmill.operators.relational import children_count, match_trips, with_section_name
from tollmill.operators.privacy import dp_count

DEFAULT_LANES = 4


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def _mean(c: str) -> Column:
    return F.coalesce(F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))


def _whole(c: str) -> Column:
    """Text as DECIMAL(10,0), rounded the way a SQL database casts it; NULL when unreadable."""
    return F.col(c).try_cast("decimal(10,0)")


def traffic_flow(entrance: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = scoped(entrance, "entrance_time", section_id, start, end)
    daily = rows.groupBy(day_label(F.col("entrance_time")).alias("date"), "vehicle_class")
    return daily.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("date"))


def revenue(exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = scoped(exit_, "exit_time", section_id, start, end)
    return (
        rows.groupBy(day_label(F.col("exit_time")).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            _total("toll_money").alias("total_toll"),
            _total("real_money").alias("total_real_money"),
            _mean("toll_money").alias("avg_toll"),
        )
        .orderBy(F.desc("date"))
    )


def vehicle_distribution(entrance: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = scoped(entrance, "entrance_time", section_id, start, end)
    counts = rows.groupBy("vehicle_class").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", shown_ratio(F.col("count"), total, 2, 100)).orderBy(F.desc("count"))


def truck_hourly_flow(
    entrance: DataFrame, section: DataFrame, section_id=None, start=None, end=None, eps: float = 1.0, seed=None
) -> DataFrame:
    """Truck entries per section and hour as a noisy count to publish. The true one (``truck_hourly_counts``) is not in it."""
    counts = truck_hourly_counts(entrance, section_id, start, end)
    named = with_section_name(counts, section)
    return dp_count(named, "truck_count", eps, seed, keys=["section_id", "hour"]).drop("truck_count")


def truck_hourly_counts(entrance: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = trucks_only(scoped(entrance, "entrance_time", section_id, start, end), "vehicle_class")
    hourly = rows.groupBy("section_id", hour_label(F.col("entrance_time")).alias("hour"))
    return hourly.agg(F.count("entrance_transaction_id").alias("truck_count"))


def avg_travel_time(exit_: DataFrame, entrance: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    """Mean minutes between entry and exit in the same section; negative spans are kept."""
    out = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    out = out.select("pass_id", "section_id", "exit_transaction_id", "exit_time")
    into = where_opt(entrance, section_id=section_id).select("pass_id", "section_id", "entrance_time")
    spent = minutes_between(F.col("entrance_time"), F.col("exit_time"))
    return (
        match_trips(out, into)
        .groupBy("section_id")
        .agg(F.sum(spent).alias("_m"), F.count(spent).alias("_n"), F.count("exit_transaction_id").alias("sample_count"))
        .select(
            "section_id",
            F.coalesce(F.try_divide(F.col("_m"), F.col("_n")), F.lit(0.0)).alias("avg_travel_time_minutes"),
            "sample_count",
        )
    )


def avg_toll_fee(exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    return rows.groupBy("section_id").agg(
        _mean("real_money").alias("avg_toll_fee"), F.count("exit_transaction_id").alias("transaction_count")
    )


def section_lanes(gantry: DataFrame) -> DataFrame:
    """Average lane count over the gantries of each section; unreadable lane texts do not count."""
    lanes = _whole("lane_count").cast("bigint")
    return gantry.groupBy("section_id").agg(F.sum(lanes).alias("lanes"), F.count(lanes).alias("gantries"))


def _per_lane(gtx: DataFrame, gantry: DataFrame, counted: Column, ratio: str, total: str) -> DataFrame:
    """Transactions per section over its lanes. The fact table is reduced to one row per gantry first."""
    by_gantry = gtx.groupBy("gantry_id").agg(F.count(counted).alias("_n"))
    by_section = (
        by_gantry.join(gantry.select("gantry_id", "section_id"), "gantry_id")
        .groupBy("section_id")
        .agg(F.sum("_n").alias(total))
    )
    known = F.col("lanes") > 0
    lanes = F.when(known, F.col("lanes")).otherwise(F.lit(DEFAULT_LANES))
    gantries = F.when(known, F.col("gantries")).otherwise(F.lit(1))
    return by_section.join(section_lanes(gantry), "section_id", "left").select(
        "section_id", total,
        shown_ratio(lanes, gantries, 1).alias("avg_lanes"), shown_ratio(F.col(total) * gantries, lanes, 2).alias(ratio),
    )


def _gantry_scope(gtx: DataFrame, gantry: DataFrame, section_id, start, end) -> tuple[DataFrame, DataFrame]:
    """The section filter goes by the section of the gantry, as the report does."""
    return scoped(gtx, "transaction_time", None, start, end), where_opt(gantry, section_id=section_id)


def congestion_index(
    gtx: DataFrame, gantry: DataFrame, section_id=None, start=None, end=None
) -> DataFrame:
    """Truck passages per lane; sections with other traffic only stay with 0."""
    rows, gantries = _gantry_scope(gtx, gantry, section_id, start, end)
    counted = F.when(truck("vehicle_type"), F.col("gantry_transaction_id"))
    return _per_lane(rows, gantries, counted, "congestion_index", "truck_count")


def lane_utilization(
    gtx: DataFrame, gantry: DataFrame, section_id=None, start=None, end=None
) -> DataFrame:
    """Truck passages per lane; sections without trucks do not appear."""
    rows, gantries = _gantry_scope(gtx, gantry, section_id, start, end)
    rows = trucks_only(rows, "vehicle_type")
    return _per_lane(rows, gantries, F.col("gantry_transaction_id"), "lane_utilization", "total_transactions")


def exit_hourly_flow(exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    return rows.groupBy("section_id", hour_label(F.col("exit_time")).alias("hour")).agg(
        F.count("exit_transaction_id").alias("truck_count"), _mean("real_money").alias("avg_toll")
    )


def _with_rate(df: DataFrame, part: str, rate: str, percent: str) -> DataFrame:
    share, total = F.col(part), F.col("total_count")
    return df.withColumns({rate: shown_ratio(share, total, 4), percent: shown_ratio(share, total, 2, 100)})


def overweight_rate(
    exit_: DataFrame, section_id=None, start=None, end=None, mask: bool = True
) -> DataFrame:
    """Trucks over their limit among trucks with usable weights; the section id is masked."""
    rows = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    rows = usable_numeric(rows, "total_weight", "total_limit")
    counts = rows.groupBy("section_id").agg(
        F.count("exit_transaction_id").alias("total_count"),
        F.count(F.when(_whole("total_weight") > _whole("total_limit"), 1)).alias("overweight_count"),
    )
    out = _with_rate(counts, "overweight_count", "overweight_rate", "overweight_percentage")
    if mask:
        out = out.withColumns({"section_id": mask_id(F.col("section_id")), "section_id_masked": F.lit(True)})
    return out


def discount_rate(exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    counts = rows.groupBy("section_id").agg(
        F.count("exit_transaction_id").alias("total_count"),
        F.count(F.when(non_blank("discount_type"), 1)).alias("discount_count"),
    )
    return _with_rate(counts, "discount_count", "discount_rate", "discount_percentage")


def peak_hours(entrance: DataFrame, section_id=None, start=None, end=None, k: int = 3) -> DataFrame:
    """Busiest hours of the day per section; the earlier hour wins a tie."""
    rows = trucks_only(scoped(entrance, "entrance_time", section_id, start, end), "vehicle_class")
    hourly = rows.groupBy("section_id", F.substring(hour_label(F.col("entrance_time")), 12, 2).alias("hour"))
    counts = hourly.agg(F.count("entrance_transaction_id").alias("truck_count"))
    return top_n_per_group(counts, "section_id", [F.desc("truck_count"), F.asc("hour")], k)


def avg_axle_count(exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    rows = trucks_only(scoped(exit_, "exit_time", section_id, start, end), "vehicle_class")
    axles = _whole("axis_count").cast("bigint")
    mean = F.coalesce(shown_ratio(F.sum(axles), F.count(axles), 2), F.lit(0.0))
    return usable_numeric(rows, "axis_count").groupBy("section_id").agg(
        mean.alias("avg_axle_count"),
        F.count("exit_transaction_id").alias("sample_count"),
    )


def station_status(station: DataFrame, section_id=None) -> DataFrame:
    label = F.when(F.col("operation_status") == "1", K.STATUS_NORMAL).otherwise(K.STATUS_ABNORMAL)
    return where_opt(station, section_id=section_id).select(
        "toll_station_id", "station_name", "section_id", "operation_status", label.alias("status_text")
    )


def station_status_summary(station: DataFrame, section_id=None) -> DataFrame:
    return station_status(station, section_id).groupBy("status_text").agg(F.count(F.lit(1)).alias("count"))


def stations_per_section(section: DataFrame, station: DataFrame) -> DataFrame:
    return children_count(
        section.select("section_id", "section_name"), station.select("section_id"), "section_id", "station_count"
    )


def truck_toll_total(exit_: DataFrame) -> DataFrame:
    return trucks_only(exit_, "vehicle_class").agg(
        _total("toll_money").alias("total_toll"), F.count(F.lit(1)).alias("transaction_count")
    )


def settlement(entrance: DataFrame, exit_: DataFrame, section_id=None, start=None, end=None) -> DataFrame:
    """Entries, exits, tolls due and paid, discount and mean paid fee, as one row."""
    n_in = scoped(entrance, "entrance_time", section_id, start, end).agg(F.count(F.lit(1))).scalar()
    return scoped(exit_, "exit_time", section_id, start, end).agg(
        n_in.alias("entrance_count"),
        F.count(F.lit(1)).alias("exit_count"),
        _total("toll_money").alias("total_toll_money"),
        _total("real_money").alias("total_real_money"),
        F.coalesce((F.sum("toll_money") - F.sum("real_money")).cast("double"), F.lit(0.0)).alias("discount_amount"),
        _mean("real_money").alias("average_fee"),
    )


def _fee_moments(rows: DataFrame, fee: str) -> Column:
    x = F.col(fee).cast("double")
    return rows.agg(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))).scalar()


def fee_anomalies(
    exit_: DataFrame, k: float = 2.0, section_id=None, start=None, end=None, fee: str = "toll_money"
) -> DataFrame:
    """Exits whose fee lies more than ``k`` standard deviations from the mean."""
    rows = scoped(exit_, "exit_time", section_id, start, end)
    m = _fee_moments(rows, fee)
    gap = F.abs(F.col(fee).cast("double") - m["mean"])
    return rows.filter(gap > F.lit(k) * m["std"]).select(
        F.col("exit_transaction_id").alias("transaction_id"), F.col(fee).cast("double").alias("fee"),
        gap.alias("deviation"), F.lit("费用异常").alias("reason"),
    )


def fee_anomaly_summary(
    exit_: DataFrame, k: float = 2.0, section_id=None, start=None, end=None, fee: str = "toll_money"
) -> DataFrame:
    rows = scoped(exit_, "exit_time", section_id, start, end)
    m = _fee_moments(rows, fee)
    far = F.abs(F.col(fee).cast("double") - m["mean"]) > F.lit(k) * m["std"]
    return rows.agg(F.count(F.lit(1)).alias("total_checked"), F.count(F.when(far, 1)).alias("anomaly_count")).select(
        "total_checked", "anomaly_count",
        F.coalesce(F.try_divide(F.col("anomaly_count") * 100.0, F.col("total_checked")), F.lit(0.0)).alias("anomaly_rate"),
        m["mean"].alias("avg_fee"), m["std"].alias("std_fee"), (m["std"] * F.lit(k)).alias("threshold"),
    )


def network_flow(entrance: DataFrame, start=None, end=None) -> DataFrame:
    """Flow per section, its mean over the days with traffic, the network total and the busiest section."""
    rows = scoped(entrance, "entrance_time", None, start, end)
    daily = rows.groupBy("section_id", "section_name", day_label(F.col("entrance_time")).alias("_day"))
    flow = (
        daily.agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("section_id", "section_name")
        .agg(F.sum("_n").alias("total_flow"), F.count(F.lit(1)).alias("days"))
    )
    whole = flow.agg(
        F.struct(
            F.sum("total_flow").alias("flow"),
            F.min_by("section_id", F.struct(-F.col("total_flow"), F.col("section_id"))).alias("busiest"),
        )
    ).scalar()
    return flow.withColumns(
        {
            "daily_avg": F.col("total_flow") / F.col("days"),
            "network_flow": whole["flow"],
            "is_busiest": F.col("section_id") == whole["busiest"],
        }
    ).orderBy(F.desc("total_flow"), "section_id")
