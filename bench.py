"""Headline queries on the bench tables; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from driftline.catalog import load

HEADLINE = [
    "trend_table",        # robust scores -> daily series -> trend test
    "stratum_stats",      # exact medians, MAD and 0.5 / 99.5 % points
    "stump_threshold",    # label-driven thresholds
    "entry_rate_baseline",
    "cusum",
    "alerts_all",         # learn the references, run all detectors
    "alert_funnel",
    "kh_sweep",           # 7 x 6 parameter grid in one job
    "permutation_scan",   # 40 label shuffles per column and label
    "spearman_matrix",
    "effect_ranking",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().queries
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, cold, rows = {}, {}, {}
    for seen in (cold, seconds):  # the first pass warms the JVM, the second one counts
        for name in HEADLINE:
            start = time.time()
            rows[name] = queries[name](spark, folder).count()
            seen[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "cold": cold, "rows": rows, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
