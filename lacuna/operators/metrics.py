"""Scores of reconstructions, and summaries of scored runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import METRICS
from . import period as per
from .order import joined, quantiles, ranked_values

EPS = 1e-8


def pointwise(df: DataFrame, by: Sequence[str] = ("fraction",), truth: str = "truth", pred: str = "imputed") -> DataFrame:
    """RMSE, MAE, MSE and mean relative error at the missing rows, in one aggregation."""
    d = F.col(pred) - F.col(truth)
    return df.where("is_missing").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"),
        F.avg(F.abs(d) / (F.abs(F.col(truth)) + EPS)).alias("relative_error"))


def r2(df: DataFrame, by: Sequence[str] = ("fraction",), truth: str = "truth", pred: str = "imputed") -> DataFrame:
    d = F.col(pred) - F.col(truth)
    return df.where("is_missing").groupBy(*by).agg((1 - F.sum(d * d) / F.nullif(F.var_pop(truth) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"))


def amplitude_error(df: DataFrame, true_amplitude: Column | float, by: Sequence[str] = ("series_id", "fraction"), pred: str = "imputed") -> DataFrame:
    """Relative error of half the range of the whole series."""
    a = F.lit(true_amplitude) if isinstance(true_amplitude, float) else F.first(true_amplitude)
    return df.groupBy(*by).agg((F.abs((F.max(pred) - F.min(pred)) / 2 - a) / (a + EPS)).alias("amplitude_error"))


def phase_error(df: DataFrame, best: DataFrame, true_phase: float = 0.0, keys: Sequence[str] = ("series_id", "fraction"), pred: str = "imputed") -> DataFrame:
    """``(*keys, phase_error, phase_error_corrected)`` at each series' best frequency (``best``: keys, freq).

    The 2 x 2 normal equations of sine and cosine without intercept. The plain column takes the arc tangent of sine over cosine
    coefficient, which is pi/2 minus the phase of a sine; the corrected one swaps them.
    """
    x = df.where(F.col(pred).isNotNull()).join(best.select(*keys, "freq"), list(keys))
    arg = F.lit(per.TWO_PI) * F.col("freq") * F.col("t")
    x = x.select(*keys, F.col(pred).alias("_y"), F.sin(arg).alias("s"), F.cos(arg).alias("c"))
    a = x.groupBy(*keys).agg(
        F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("s") * F.col("c")).alias("sc"),
        F.sum(F.col("s") * F.col("_y")).alias("sy"), F.sum(F.col("c") * F.col("_y")).alias("cy"))
    det = F.nullif(F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc"), F.lit(0.0))
    a = a.withColumn("bs", (F.col("cc") * F.col("sy") - F.col("sc") * F.col("cy")) / det).withColumn("bc", (F.col("ss") * F.col("cy") - F.col("sc") * F.col("sy")) / det)

    def wrapped(angle: Column) -> Column:
        d = F.pmod(F.abs(angle - true_phase), F.lit(per.TWO_PI))
        return F.coalesce(F.least(d, per.TWO_PI - d) / per.TWO_PI, F.lit(1.0))

    return a.select(*keys, wrapped(F.atan2("bs", "bc")).alias("phase_error"), wrapped(F.atan2("bc", "bs")).alias("phase_error_corrected"))


def evaluate(df: DataFrame, truth: DataFrame, tol: float = 0.01, true_phase: float = 0.0, keys: Sequence[str] = ("series_id", "fraction")) -> DataFrame:
    """The ten scores per series and fraction. ``truth``: series_id, true_period, true_amplitude.

    The periodogram is computed once and serves both the period and the phase.
    """
    point = pointwise(df, keys).drop("n")
    rec = per.period_recovery(df, truth.select("series_id", "true_period"), tol, keys)
    amp = df.groupBy(*keys).agg(((F.max("imputed") - F.min("imputed")) / 2).alias("_amp")).join(truth.select("series_id", "true_amplitude"), "series_id")
    amp = amp.select(*keys, (F.abs(F.col("_amp") - F.col("true_amplitude")) / (F.col("true_amplitude") + EPS)).alias("amplitude_error"))
    phase = phase_error(df, rec, true_phase, keys).select(*keys, "phase_error")
    out = point.join(rec.select(*keys, "period_recovered", "period_rel_err"), list(keys)).join(amp, list(keys)).join(phase, list(keys))
    runtime = F.first("runtime_s") if "runtime_s" in df.columns else None
    if runtime is not None:
        return out.join(df.groupBy(*keys).agg(runtime.alias("runtime_s"), F.first("memory_mb").alias("memory_mb")), list(keys))
    return out.withColumns({"runtime_s": F.lit(None).cast("double"), "memory_mb": F.lit(None).cast("double")})


def relative_period_error(true: Column, imputed: Column) -> Column:
    return F.abs(imputed - true) / true


def period_recovery_rate(df: DataFrame, true: str = "p_true", imputed: str = "p_imp", threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    hit = relative_period_error(F.col(true), F.col(imputed)) < threshold
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("prr"))


def accuracy_loss(base: Column, imputed: Column) -> Column:
    return base - imputed


def feature_distortion(imputed: DataFrame, true: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id",), eps: float = 1e-8) -> DataFrame:
    """``(feature, distortion)``: mean of abs(difference) / (abs(true) + eps)."""
    long = lambda df, name: df.unpivot(list(keys), list(features), "feature", name)
    both = long(imputed, "imp").join(long(true, "tru"), [*keys, "feature"])
    return both.groupBy("feature").agg(F.avg(F.abs(F.col("imp") - F.col("tru")) / (F.abs(F.col("tru")) + eps)).alias("distortion"))


def safe_threshold(losses: DataFrame, threshold: float = 0.05, by: Sequence[str] = ("method",)) -> DataFrame:
    """``(*by, p_star)``: the fraction where the loss first reaches ``threshold``, interpolated from (0, 0); infinite if never."""
    w = Window.partitionBy(*by).orderBy("fraction")
    x = losses.withColumn("p0", F.coalesce(F.lag("fraction").over(w), F.lit(0.0))).withColumn("l0", F.coalesce(F.lag("loss").over(w), F.lit(0.0)))
    cross = F.when(F.col("loss") >= threshold, F.col("p0") + (threshold - F.col("l0")) / F.nullif(F.col("loss") - F.col("l0"), F.lit(0.0)) * (F.col("fraction") - F.col("p0")))
    x = x.withColumn("_p", F.when(F.col("loss") >= threshold, F.coalesce(cross, F.col("fraction"))))
    return x.groupBy(*by).agg(F.coalesce(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("fraction"))), F.lit(float("inf"))).alias("p_star"))


def summarise(raw: DataFrame, by: Sequence[str] = ("method", "fraction"), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample deviation of the metrics that are there, and the period recovery rate."""
    have = [m for m in metrics if m in raw.columns]
    aggs = [f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in have for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    if "period_recovered" in have:
        aggs.append(F.avg(F.col("period_recovered").cast("double")).alias("prr"))
    return raw.groupBy(*by).agg(*aggs)


def costs(imputed: DataFrame, run: Sequence[str], by: Sequence[str] = ("method",)) -> DataFrame:
    """``(*by, n_runs, n_failed, runtime_mean, runtime_max, memory_peak)`` of imputed rows; a run is one series with its gaps, counted once. Null where a method has no
    run of its own (window methods)."""
    runs = imputed.groupBy(*by, *run).agg(F.max("runtime_s").alias("runtime_s"), F.max("memory_mb").alias("memory_mb"), F.max(F.col("failed").cast("int")).alias("failed"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("failed").alias("n_failed"), F.avg("runtime_s").alias("runtime_mean"), F.max("runtime_s").alias("runtime_max"), F.max("memory_mb").alias("memory_peak"))


def summarise_cube(raw: DataFrame, by: Sequence[str] = ("method", "fraction"), metrics: Sequence[str] = METRICS, rollup: bool = False) -> DataFrame:
    """``summarise`` over every subset of ``by`` (``rollup``: its prefixes) in one pass: rows multiply map-side, before the combine. ``level`` is the grouping
    number: a bit per name, the last one lowest, set where the name is summed over; it tells such a null from one among the data."""
    have = [m for m in metrics if m in raw.columns]
    sets = raw.rollup(*by) if rollup else raw.cube(*by)
    aggs = [f(F.col(m).cast("double")).alias(f"{m}_{n}") for m in have for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *aggs)


def two_level(raw: DataFrame, metric: str, by: Sequence[str] = ("method", "fraction"), seed: str = "seed") -> DataFrame:
    """Mean per seed first, then mean and population deviation over seeds."""
    per_seed = raw.groupBy(*by, seed).agg(F.avg(metric).alias("_m"))
    return per_seed.groupBy(*by).agg(F.avg("_m").alias(f"{metric}_mean"), F.stddev_pop("_m").alias(f"{metric}_std"))


def describe(df: DataFrame, value: str = "flux", by: Sequence[str] = (), **options) -> DataFrame:
    """Count, mean, median, deviation and range; groups without a value have nulls."""
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = quantiles(df, value, (0.5,), by, **options).select(*by, F.col("q")[0].alias("median"))
    out = joined(plain, middle, by, "left") if by else plain.join(middle, how="left")
    return out.select(*by, "n", "mean", "median", "std", "min", "max")


def correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.corr(a, b).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for all column pairs, from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    half = one.select(F.explode(table).alias("x")).select("x.*")
    return half.unionAll(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))


def pivot(df: DataFrame, rows: str, column: str, metric: str, values: Sequence) -> DataFrame:
    """Rows x known column values, so that Spark needs no pass to find them."""
    return df.groupBy(rows).pivot(column, list(values)).agg(F.avg(metric))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bin, n)``, bins from 0; the upper edge belongs to the last bin."""
    b = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return df.where(F.col(value).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, value: str, lo: float, hi: float, bins: int, bandwidth: float, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bin, x, n, density)``: a Gaussian kernel density at the middles ``x`` of ``bins`` bins, the curve of a violin or density plot.

    Rows are counted per bin map-side, then each bin's count is spread over the bins within four bandwidths: ``bins`` rows a group, however many values it has. The share of
    all values of the group within [lo, hi] is the curve's whole; bins that no value reaches have no row.
    """
    width = (hi - lo) / bins
    reach = max(1, math.ceil(4 * bandwidth / width))
    counts = histogram(df, value, lo, hi, bins, by)
    steps = F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - reach), F.least(F.lit(bins - 1), F.col("bin") + reach)))
    spread = counts.select(*by, "bin", F.col("n").alias("_c"), steps.alias("_to"))
    z = (F.col("_to") - F.col("bin")) * (width / bandwidth)
    kernel = F.exp(-z * z / 2) / (bandwidth * math.sqrt(2 * math.pi))
    sums = spread.groupBy(*by, F.col("_to").alias("bin")).agg(F.sum(F.when(F.col("_to") == F.col("bin"), F.col("_c")).otherwise(0)).alias("n"), F.sum(F.col("_c") * kernel).alias("_d"))
    total = F.sum("n").over(Window.partitionBy(*by))  # bins rows a group
    return sums.select(*by, "bin", (lo + (F.col("bin") + 0.5) * width).alias("x"), "n", (F.col("_d") / total).alias("density"))


def boxplot(df: DataFrame, value: str, by: Sequence[str] = ("method",), **options) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges. Nulls don't count; no group's values meet in one task."""
    values = ranked_values(df.where(F.col(value).isNotNull()), by, [value], **options)
    q = quantiles(df, value, (0.25, 0.5, 0.75), by, **options).drop("n")
    x = joined(values, q, by) if by else values.crossJoin(q)  # one row
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    fits = F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    inside = F.when(fits, F.col(value))
    return x.groupBy(*by).agg(
        F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"),
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.sum(F.when(fits, 0).otherwise(F.col("ties"))).alias("n_outliers"))


def ranking(summary: DataFrame, metric: str, by: Sequence[str] = ("method",)) -> DataFrame:
    return summary.select(*by, metric).orderBy(F.col(metric).asc_nulls_last(), *by)
