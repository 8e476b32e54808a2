"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "revenue_by_brand", "multi_output_reduce", "fused_sums", "groupby_sum", "groupby_mean_high_cardinality", "group_statistics", "moments",
    "describe", "inner_join", "first_match_join", "filter_mask", "recipes", "quantiles", "rolling_pipeline", "scans", "cadence_roll_up",
    "ohlcv_hourly", "tick_counts", "realized_measures", "autocorrelation", "mann_whitney", "knn", "kmeans", "dbscan", "chain_descriptive", "pagerank", "heavy_hitters",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.plans import registry

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):  # the first also compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
