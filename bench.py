"""Time the headline queries and print one JSON line.

Each query runs once into a sink that keeps nothing, after one small query that starts the
session. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tallyspark.plans.queries import all_queries
from tallyspark.session import local_session

HEADLINE = (
    "clean_ledger", "true_income_split", "weekly_base", "weekly_single_ledger", "weekly_events_by_user",
    "weekly_category_long", "weekly_category_pivot", "weekly_rolling", "outlier_weeks_kept",
    "scaled_features", "anomaly_scores", "anomaly_thresholds", "top_contributions", "cluster_summary",
    "monthly_base", "forecast_dataset", "latest_month_snapshot", "baseline_metrics", "budget_risk",
    "risk_fusion", "payload_violations", "kmeans_anomaly", "kmeans_profiler", "forecast_candidates",
    "risk_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    queries = all_queries()
    queries["risk_levels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "lineitem_rows": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(),
            }
        )
    )


if __name__ == "__main__":
    main()
