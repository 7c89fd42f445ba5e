"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "impute_mean", "impute_ffill", "impute_linear", "impute_knn", "impute_spline", "impute_gp", "impute_ts_mice", "impute_rf", "impute_mf", "impute_gb_mice", "impute_rnn", "impute_gain", "impute_saits",
    "metric_pointwise", "summarise_results", "rolling_median", "preprocess_full", "gap_runs", "lag_phase_matrix", "period_estimate", "features_35", "stats_table",
)


def main() -> None:
    from lacuna.plans import catalogue
    from lacuna.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    found, times = catalogue.queries(), {}
    found["impute_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session warms up once
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
