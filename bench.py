"""Times the headline queries and prints one JSON line.

Every query is run to completion into a sink that keeps nothing, so all its columns are
computed. One untimed pass of a small query starts the engine first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from tollmill.plans import registry
from tollmill.session import build_session

HEADLINE = [
    "a1_traffic_flow", "a2_revenue", "a4_truck_hourly_flow", "a5_avg_travel_time", "a7_congestion_index",
    "a9_overweight_rate", "a11_peak_hours", "a22_value_frequency", "a30_profile_numeric", "a33_fee_mileage_stats",
    "a35_diversity_counts", "a38_settlement", "a39_fee_anomalies", "a40_network_flow", "a43_trace_tree", "pv4_k_anonymize", "q1_check_rules", "q4_section_date_errors", "q5_repair",
    "q7_recover", "q9_iterative_weights", "q12_zscore_fix", "q17_exemplar_quality", "q20_select_exemplars",
    "e1_js_divergence", "e6_benchmark_similarity", "e9_direct_score", "e15_task_overall", "g1_resample", "g3_rebalance",
    "m3_distance_anomaly", "st1_stream_hourly_flow",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = build_session(
        "bench", f"local[{cpus}]", spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='bench-')}", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    registry.QUERIES["src8_gantry_dimension"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
