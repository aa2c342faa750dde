"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetcast.catalog import QUERIES
from fleetcast.session import local_session

HEADLINE = [
    "s4_product_fleet", "v09_regular_spacing", "v12_profile", "c1_complete_fleet", "j1_outer_alignment", "a20_metric_report",
    "a22_correlation_matrix", "a25_gram", "w1_lag_features", "d1_decompose_fleet", "d2_stl", "r1_mlr_accuracy", "r1_mlr_fleet",
    "r3_ridge_fleet", "r5_lasso", "r6_elastic_net_fleet", "h2_smoothing_fits", "h4_smoothing_fleet", "x2_sarima_candidates",
    "x7_sarima_fleet", "t1_random_forest", "t2_gradient_boosting",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run starts the Python workers and compiles the common code paths.
    QUERIES["r1_mlr_accuracy"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
