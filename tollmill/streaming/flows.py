"""Streaming forms of the hourly truck flow and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollmill.operators.filters import trucks_only


def stream_hourly_flow(stream: DataFrame, watermark: str = "2 hours", ts: str = "entrance_time") -> DataFrame:
    """Truck entries per section and hour; an hour is final once the watermark has passed it.

    Event time needs a zoned timestamp, so wall-clock times are read in the session zone.
    """
    timed = trucks_only(stream, "vehicle_class").withColumn("_ts", F.col(ts).cast("timestamp"))
    hours = timed.withWatermark("_ts", watermark).groupBy(F.window("_ts", "1 hour").alias("_w"), "section_id")
    return hours.agg(F.count("entrance_transaction_id").alias("truck_count")).select(
        "section_id", F.date_format(F.col("_w")["start"], "yyyy-MM-dd HH").alias("hour"), "truck_count"
    )


def stream_pair_audit(starts: DataFrame, ends: DataFrame, bound: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Start and end rows of a call joined into one record, if the end follows within the bound."""
    s = starts.withColumn("_s", F.col("created_at").cast("timestamp")).withWatermark("_s", watermark)
    e = ends.withColumnRenamed("trace_id", "_trace").withColumn("_e", F.col("ended_at").cast("timestamp"))
    e = e.withWatermark("_e", watermark)
    within = (F.col("_e") >= F.col("_s")) & (F.col("_e") <= F.col("_s") + F.expr(f"interval {bound}"))
    joined = s.join(e, (F.col("trace_id") == F.col("_trace")) & within, "inner")
    status = F.col("response_status")
    return joined.withColumns(
        {
            "response_time_ms": F.timestamp_diff("MILLISECOND", F.col("created_at"), F.col("ended_at")),
            "is_success": status.between(200, 399),
        }
    ).drop("_s", "_e", "_trace")


def stream_retention(stream: DataFrame, days: int = 90, now=None, watermark: str = "2 hours", key: str = "id") -> DataFrame:
    """Audit rows of the last days without repeats. ``now`` fixes the reference moment, e.g. in tests."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    timed = stream.withColumn("_ts", F.col("created_at").cast("timestamp")).withWatermark("_ts", watermark)
    recent = timed.filter(F.col("_ts") > at - F.expr(f"interval {days} days"))
    return recent.dropDuplicatesWithinWatermark([key]).drop("_ts")


def run_hourly_flow(stream: DataFrame, out: str, state: str, watermark: str = "2 hours", ts: str = "entrance_time") -> None:
    """Runs the hourly flow over all available input, writing the changed hours of every batch to ``out``.

    A batch that is run again overwrites its own folder, so a lost executor or a restart adds nothing twice.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    flow = stream_hourly_flow(stream, watermark, ts)
    writer = flow.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()


def latest_flow(written: DataFrame) -> DataFrame:
    """The last figure written for every section and hour."""
    return written.groupBy("section_id", "hour").agg(F.max_by("truck_count", "version").alias("truck_count"))
