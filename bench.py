"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from heliofleet.catalog import all_queries  # noqa: E402
from heliofleet.session import build_session  # noqa: E402

HEADLINE = (
    "rolling_daily", "e1_daily_sum", "e2_monthly_sum", "e16_production_statistics",
    "e25_quality_score", "e27_temporal_completeness", "e24_iqr_outlier_counts", "c4_merge_csv_first",
    "c1_merge_weather_hourly", "f3_temporal_rolling", "f7_volatility_trend", "j8_enrich_readings",
    "e32_financial_analysis", "e48_optimal_conditions", "k1_ml_dataset_basic", "k2_temporal_features",
    "k6_feature_set", "a5_energy_lifetime", "l1_streaming_daily",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
