"""Experiment plans: gapped series through several imputers to scored runs, summaries and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps, impute, metrics, stats
from ..operators import registry
from ..operators.period import period_estimate
from ..sources.config import make_seed_sequence
from ..sources.sinks import save_parquet, save_results, save_table

FRACTIONS = (0.1, 0.3, 0.5)


def native_methods(gapped: DataFrame) -> DataFrame:
    """``(method, *keys, t, event_id, is_missing, truth, imputed)`` of the three window imputers, from one exchange,
    dealt by the number of rows: each adds a column, and one generator turns the columns into rows."""
    x = impute.dealt(gapped.select("series_id", "fraction", "t", "event_id", "is_missing", "obs", "truth"))
    x = impute.forward_fill(x).withColumnRenamed("imputed", "f")
    x = impute.linear(x).withColumnRenamed("imputed", "l")
    x = impute.mean_fill(x).withColumnRenamed("imputed", "m")  # last: any order of a series will do
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("imputed")) for n, c in (("Mean-Fill", "m"), ("Forward-Fill", "f"), ("Linear-Interp", "l"))]))
    return x.select("series_id", "fraction", "t", "event_id", "is_missing", "truth", rows.alias("x")).select("x.method", "series_id", "fraction", "t", "event_id", "is_missing", "truth", "x.imputed")


def native_results(gapped: DataFrame) -> DataFrame:
    """``(method, fraction, seed, rmse, mae, mse, relative_error)``: one scored run a method, fraction and series."""
    return metrics.pointwise(native_methods(gapped), ("method", "fraction", "series_id")).withColumnRenamed("series_id", "seed")


def run_grid(series: DataFrame, methods: Mapping[str, Mapping] | Sequence[str], fractions: Sequence[float] = FRACTIONS, n_seeds: int = 3, base_seed: int = 42, variant: str = "index", **gap_options) -> DataFrame:
    """Gaps once per (series, fraction, seed), then every method on the same gaps: ``(method_key, method, ..., imputed, failed)``.

    ``series``: series_id, t, flux. Kernels get the period estimated from the observed samples of each gapped series. The gapped frame sits below the methods, so its exchange is reused.
    """
    params = methods if isinstance(methods, Mapping) else {m: {} for m in methods}
    x = gaps.inject_gaps(series.select("series_id", "t", "flux"), fractions, make_seed_sequence(n_seeds, base_seed), variant, **gap_options)
    keys, order = ("series_id", "fraction", "seed"), ("t",)
    kernels = x
    if any(not registry.get_imputer(key).plan for key in params):  # the others take no period
        periods = period_estimate(x, keys)
        kernels = x.join(periods, list(keys), "left").withColumn("period", F.coalesce("period", F.lit(1.0)))
    out = None
    for key, options in params.items():
        one = registry.impute(x if registry.get_imputer(key).plan else kernels, key, options, keys, order).drop("period")
        out = one if out is None else out.unionByName(one)
    return out


def score_grid(imputed: DataFrame, truth: DataFrame, tol: float = 0.01) -> DataFrame:
    """RAW_RESULT rows of an imputed grid; ``truth``: series_id, true_period, true_amplitude."""
    return metrics.evaluate(imputed, truth, tol, keys=("series_id", "method_key", "method", "fraction", "seed"))


def run_experiment(spark: SparkSession, series: DataFrame, truth: DataFrame, config: Mapping, out_dir: str | None = None) -> dict[str, DataFrame]:
    """The whole experiment of a configuration mapping: raw results, summary, statistics, and files if ``out_dir`` is given."""
    active = [k for k, on in config.get("methods", {"linear_interp": True, "mean_fill": True}).items() if on]
    params = {k: config.get("params", {}).get(k, {}) for k in active}
    miss = config.get("missingness", {})
    grid = run_grid(series, params, miss.get("fractions", FRACTIONS), config.get("n_seeds", 3), config.get("base_seed", 42))
    raw = score_grid(grid, truth, config.get("evaluation", {}).get("period_tol", 0.01))
    if out_dir:
        save_parquet(raw, f"{out_dir}/raw", ("fraction",))
        raw = spark.read.parquet(f"{out_dir}/raw")
    summary = metrics.summarise(raw)
    table = stats.stats_table(raw, baseline=config.get("baseline", "Linear-Interp"))
    if out_dir:
        save_results(summary, f"{out_dir}/summary")
        save_table(table, f"{out_dir}/stats.tex")
    return {"raw": raw, "summary": summary, "stats": table}
