"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fluxlane.plans import catalog

HEADLINE = (
    "flagship_signal_change", "select_line_lookup", "split3_sequential", "fdm_central", "fdm_fourth", "lag_1_2_3", "temporal_window_pad", "detrend_linear", "autocorr_lags", "filtfilt_bandpass",
    "norm_standardize", "err_segs", "linreg_solve2", "tl_full_with_bias", "feature_matrix", "euler_dcm", "grid_build", "grid_border", "grid_fill_knn", "grid_bilinear", "fft_upward", "ekf_track", "drms_eval", "stream_window_count",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first compiles code and touches files
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
