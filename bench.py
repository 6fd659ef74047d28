"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times for the median, every run from a new plan and to
the last row. ``etl_clean_features`` is the whole clean-and-derive job from the raw events; the other
queries read the cleaned tables it stands for, as they do after the first use in a session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from trailmark.operators import cleaning
from trailmark.plans import registry
from trailmark.session import get_session
from trailmark.sources.tables import workspace

HEADLINE = [
    "cleaning_report",
    "daily_metrics",
    "int_user_daily_metrics",
    "mart_daily_kpi",
    "headline_metrics",
    "retention_d137",
    "cohort_pivot",
    "user_funnel",
    "int_conversion_funnel",
    "rf_segment_summary",
    "mart_user_segments",
    "user_profile",
    "ltv_segment_summary",
    "ab_group_stats",
    "two_proportion_z",
    "recommender_lift",
    "zscore_anomalies",
    "hourly_anomalies",
    "top_items",
    "category_efficiency",
    "co_purchase_pairs",
    "co_purchase_pairs_orders",
    "item_cf_similarity",
    "item_cf_recommend",
    "popularity_recommend",
    "user_cf_recommend",
    "churn_features",
    "churn_metrics",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = get_session("bench", cores=os.environ.get("BENCH_CPUS"))
    spark.sparkContext.setLogLevel("ERROR")
    w = workspace(spark, folder)
    runs = {"etl_clean_features": lambda: cleaning.time_features(cleaning.clean_events(w.raw))}
    queries = registry.queries()
    runs.update({name: (lambda q=queries[name]: q(spark, folder)) for name in HEADLINE})
    seconds = {}
    for name, run in runs.items():
        timed(run)
        seconds[name] = round(statistics.median(timed(run) for _ in range(rounds)), 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
