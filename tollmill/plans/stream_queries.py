"""Streaming queries (ST*). Each reads its table as a file stream until it is exhausted."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollmill.plans.registry import TRUCKS, query
from tollmill.plans.views import TollViews
from tollmill.session import scratch_path
from tollmill.streaming import flows


class StreamedViews(TollViews):
    """The same views, with the fact tables read as streams."""

    streamed = {"orders", "events"}

    def table(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().table(name)
        schema = super().table(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.directory}/{name}.parq*t")


def _streamed(v) -> StreamedViews:
    return StreamedViews(v.spark, v.directory)


def _append(stream: DataFrame, v) -> DataFrame:
    """Runs a stream to its end in append mode and reads what it wrote."""
    out, state = scratch_path(v.spark, "out"), scratch_path(v.spark, "state")
    sink = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
    sink.trigger(availableNow=True).start(out).awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


@query("st1_stream_hourly_flow", f"""
    select section_id, strftime(entrance_time, '%Y-%m-%d %H') as hour, count(*) as truck_count
    from v_entrance where vehicle_class in {TRUCKS} group by 1, 2""")
def st1(v):
    out = scratch_path(v.spark, "flow")
    flows.run_hourly_flow(_streamed(v).entrance, out, scratch_path(v.spark, "state"))
    return flows.latest_flow(v.spark.read.parquet(out))


_STATUS = "case when event_type = 'error' then 500 else 200 end"


@query("st2_stream_pair_audit", f"""
    select concat('tr', cast(event_id as varchar)) as trace_id, cast(floor(value) as bigint) as response_time_ms,
           {_STATUS} < 400 as is_success from events""")
def st2(v):
    s = _streamed(v)
    starts = s.audit.select("trace_id", "created_at", "api_endpoint")
    ended = s.audit.withColumn("response_status", F.when(F.col("is_success"), 200).otherwise(500))
    paired = flows.stream_pair_audit(starts, ended.select("trace_id", "ended_at", "response_status"))
    return _append(paired.select("trace_id", "response_time_ms", "is_success"), v)


@query("st3_stream_retention", """
    select id, user_id from v_audit where created_at > timestamp '2024-01-12' - interval 5 day""")
def st3(v):
    audit = _streamed(v).audit.select("id", "user_id", "created_at")
    repeated = audit.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    kept = flows.stream_retention(repeated, 5, "2024-01-12 00:00:00")
    return _append(kept.select("id", "user_id"), v)
