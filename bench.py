"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Reports recompute everything they need. The model steps follow each other as in a real run:
each is timed on the stored result of the steps before it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import queries as q
from tillroll.session import local_session

REPORTS = [
    "clean_transactions",
    "cleaning_report",
    "daily_revenue",
    "monthly_revenue",
    "day_hour_activity",
    "top_products_revenue",
    "rfm",
    "spend_summary",
    "spend_kde",
    "customer_features",
]
STEPS = [
    "feature_describe",
    "feature_histogram",
    "feature_boxstats",
    "boxcox_lambda",
    "scaled_describe",
    "pca_scores",
    "kmeans_labels",
    "k_selection",
    "cluster_means",
    "radar_profile_8",
    "surrogate_accuracy",
    "shap_values",
    "shap_summary",
]


def run(spark, sf: str, name: str) -> float:
    start = time.perf_counter()
    q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf, "top_products_quantity")  # starts the JVM's code paths, not timed
    took = {}
    for name in REPORTS:
        q.forget()
        took[name] = round(run(spark, sf, name), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    q.customer_table(spark, sf)
    for name in STEPS:
        took[name] = round(run(spark, sf, name), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
