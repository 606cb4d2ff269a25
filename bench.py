"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma separated names instead of the headline list
"""

import json
import logging
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "headway_gaps", "five_minute_metrics", "daily_service_rollup", "delay_events", "bunching_events", "system_health", "route_performance",
    "delay_trend", "schedule_deviation", "tiered_schedule_lookup", "stop_steps", "duration_matrix", "segment_durations", "common_stop_patterns",
    "schedule_statistics", "busiest_stations", "next_arrivals", "arrival_boards", "bracketing_positions", "monthly_reliability", "division_months",
    "delay_feature_windows", "delay_features", "ridership_features", "yearly_decomposition", "trip_sessions", "poll_changes", "position_trajectories",
    "map_matched_positions", "nearest_stations", "proximity_clusters", "graph_ride_edges", "least_cost_paths", "trip_legs", "alerts_by_route",
    "lead_sentences", "news_items", "streamed_window_metrics",
]


def main() -> None:
    from stopflow.plans import catalog
    from stopflow.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
