"""``python -m lacuna --config FILE [--out DIR] [--dry-run]``: an experiment on generated series."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .functions.signal import generate_series
from .operators import registry
from .plans.experiment import run_experiment
from .session import build_session
from .sources.config import load_config, make_seed_sequence


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lacuna", description=__doc__)
    p.add_argument("--config", help="YAML file: signal, methods, params, missingness, n_seeds, base_seed, evaluation")
    p.add_argument("--out", help="folder for raw results, summary and table")
    p.add_argument("--dry-run", action="store_true", help="print the grid and stop")
    a = p.parse_args(argv)
    config = load_config(a.config) if a.config else {}
    unknown = set(config.get("methods", {})) - set(registry.list_imputers())
    if unknown:
        p.error(f"unknown methods: {', '.join(sorted(unknown))}")
    signal = {"N": 1323, "dt": 0.0204, "P0": 1.0, "A": 0.1} | config.get("signal", {})
    if a.dry_run:
        print(json.dumps({"signal": signal, "methods": config.get("methods", {}), "missingness": config.get("missingness", {})}, indent=2))
        return 0
    spark = build_session("lacuna", None)
    series = generate_series(spark, seeds=make_seed_sequence(config.get("n_series", 1)), **signal).select("series_id", "t", "flux")
    truth = series.select("series_id").distinct().withColumns({"true_period": F.lit(float(signal["P0"])), "true_amplitude": F.lit(float(signal["A"]))})
    out = run_experiment(spark, series, truth, config, a.out)
    out["summary"].show(truncate=False)
    out["stats"].show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
