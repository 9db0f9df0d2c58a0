"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelfwise.plans.catalog import QUERIES
from shelfwise.sources.session import local_session

HEADLINES = [
    "Q17_foreign_keys",
    "Q25_distribution_summary",
    "J05_star_flatten",
    "J07_match_returns",
    "A01_group_stats",
    "A02_distinct_counts",
    "T02_densify",
    "T06_rolling",
    "T17_inter_event_gap",
    "T20_cumulative_share",
    "T31_autocorrelation",
    "D02_best_month_per_year",
    "D12_global_anomalies",
    "D22_group_revenue",
    "D27_pareto",
    "D31_rolling_concentration",
    "D41_cohort_retention",
    "D49_promo_calendar",
    "D54_promo_decomposition",
    "D60_order_level",
    "D68_revenue_decomposition",
    "D76_conversion_daily",
    "D84_overstock",
    "D92_return_rate",
    "D107_payment_methods",
    "D111_delivery_by_region",
    "D116_regional_matrix",
    "F06_history_features",
    "F13b_fold_predictions",
    "F16_global_scale",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
