"""Wall-clock seconds of the headline queries, each run once before it is timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ("signal_profile", "rolling_stats", "longest_run_bridged", "frame_moments", "score_map", "rfft_amplitude", "lag_scan", "split_search", "forecast_scores", "conformal_grid", "label_ensemble", "knn_regress", "group_median", "zscore")


def main() -> None:
    from pyspark.sql import SparkSession

    from trackloom.plans.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:  # the first run starts workers and compiles code
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
