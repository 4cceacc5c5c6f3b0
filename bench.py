"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times into a no-op sink; the median counts. Rows per second
of the ingest-side work are reported next to the times.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from beaconry.plans.catalog import ENTRIES

HEADLINE = [
    "rollup_1m", "rollup_5m_node", "rollup_5m_region", "rollup_hourly", "rollup_daily", "fleet_by_node", "fleet_by_region",
    "fleet_tier_one_hour", "cluster_summary", "regional_breakdown", "top_problem_nodes", "kpi_stats", "list_metrics_page",
    "list_nodes", "dedup_metrics", "insert_first_wins", "conflict_audit", "normalize_metrics", "latest_per_node",
    "rolling_anomaly", "evaluate_rules", "alert_cooldown", "alert_node_quota", "greedy_cooldown", "pending_alerts",
    "debounce_levels", "token_bucket", "admit_envelopes", "log_volume", "quality_report", "run_alerts", "metric_rules",
    "dispatch_payload", "stream_rollup_1m",
    "fleet_p95_from_daily_sketches", "fleet_wide_windows", "refresh_rollup_5m", "list_metrics_by_cursor", "stream_dedup",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 4)
    rates = {n: round(events / times[n]) for n in ("rollup_1m", "dedup_metrics", "insert_first_wins", "rolling_anomaly",
                                                  "evaluate_rules", "alert_cooldown") if n in times}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "rows": events, "rows_per_sec": rates}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
