"""Wall seconds of the headline queries; prints one JSON line.

One query runs first to warm the JVM. Every query runs ``BENCH_RUNS`` times and the best time counts.
Cached tables are dropped before each run, so a run pays for the whole plan from the files on.
"""

from __future__ import annotations

import json
import os
import time

from voltmes.plans.catalog import QUERIES
from voltmes.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINES = [
    "filter_segment", "panel_join", "weather_rollup", "key_coverage", "features", "lags_by_meter", "prepared_rows", "recommend",
    "ptbr_parse_strict", "clean_counts", "winsorize", "scan_ptbr_csv", "station_union",
    "describe", "describe_readings", "quantiles", "iqr_readings", "corr_pearson", "corr_spearman_stations", "histogram",
    "holdout_bills", "holdout_random", "tscv_meter", "metrics_region", "leaderboard", "class_metrics",
    "standardize", "robust_scale", "linreg_readings", "knn_cls", "isolation_forest_stations", "cv_linear", "cv_forest",
    "cv_leafwise", "tuned_forest", "predictions_sink",
]


def main() -> None:
    spark = local_session(CORES, "bench", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    QUERIES["features"](spark, FOLDER).collect()
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINES:
        times = []
        for _ in range(RUNS):
            spark.catalog.clearCache()
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
