"""The 35 features of a series, as aggregations over one shared window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURES
from . import period as per
from .impute import dealt
from .spectra import fast_peaks

LAGS = (1, 2, 3, 5, 10, 20)
TINY = 1e-10


def _zero(x: Column) -> Column:
    """Undefined or non-finite values count as zero."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))


def shape_features(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("t", "event_id"), value: str = "flux", error: str | None = None) -> DataFrame:
    """All features but the spectral ones. Unordered statistics and lagged products come from two aggregations over
    rows that were sorted once; NULL values are left out first. Dealt by the number of rows: a task holds some 200,000 or one series."""
    x = dealt(df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).alias("y"), (F.col(error) if error else F.lit(1.0)).alias("e0")), keys)
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    # ranked first, while rows are narrow: all other windows then share one sort
    x = x.withColumn("r", F.row_number().over(whole.orderBy("y", *order)) - 1)
    if error:
        good = F.when(F.col("e0") > 0, F.col("e0"))
        x = x.withColumn("e", F.coalesce(good, F.median(good).over(whole)))
    else:
        x = x.withColumn("e", F.col("e0"))
    x = x.withColumn("wt", 1 / (F.col("e") * F.col("e") + 1e-20)).withColumn("wt1", 1 / (F.col("e") * F.col("e")))
    along = {"i": F.row_number().over(w) - 1} | {f"l{k}": F.lag("y", k).over(w) for k in LAGS} | {"next": F.lead("y").over(w), "e_next": F.lead("e").over(w)}
    x = x.withColumns(along).withColumns({
        "n": F.count(F.lit(1)).over(whole), "m": F.avg("y").over(whole), "v": F.var_pop("y").over(whole), "med": F.median("y").over(whole),
        "q": F.expr("percentile(y, array(0.05, 0.95, 0.1, 0.9, 0.25, 0.75))").over(whole),
        "wm": F.sum(F.col("wt") * F.col("y")).over(whole) / F.sum("wt").over(whole), "jm": F.sum(F.col("wt1") * F.col("y")).over(whole) / F.sum("wt1").over(whole)})
    # percentiles among the last aggregates would make it a hash aggregate of objects, which sorts its rows again beyond 128 series a task
    x = x.withColumns({"ws": F.sqrt(F.sum(F.col("wt") * (F.col("y") - F.col("wm")) ** 2).over(whole) / F.sum("wt").over(whole)), "mad": F.expr("percentile(abs(y - med), 0.5)").over(whole)})
    apart = lambda y, e: F.sqrt(F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))) * (F.col(y) - F.col("jm")) / F.col(e)
    x = x.withColumns({"delta": apart("y", "e"), "delta2": apart("next", "e_next"), "dy": F.col("y") - F.col("l1"), "dy0": F.col("l1") - F.col("l2")})
    d, n, m, v = F.col("y") - F.col("m"), F.first("n"), F.first("m"), F.first("v")
    lo = F.floor(F.lit(0.05) * F.col("n"))
    pair = F.col("delta") * F.col("delta2")
    sd = F.sqrt("v")
    sigma = F.when(F.col("ws") > 0, F.col("ws")).otherwise(F.lit(1.0))
    aggs = {
        "n": n, "flux_mean": F.first("wm"), "flux_std": F.first("ws"), "std_pop": F.sqrt(v), "med": F.first("med"),
        "m3": F.avg(d * d * d), "m4": F.avg(d * d * d * d), "v": v,
        "flux_mad": F.first("mad"),
        "stetson_j": F.avg(F.when((F.col("i") % 2 == 0) & F.col("delta2").isNotNull(), F.signum(pair) * F.sqrt(F.abs(pair)))),
        "kz": F.avg(F.abs(d) / F.nullif(sd, F.lit(0.0))), "kz2": F.avg(d * d / F.nullif(F.col("v"), F.lit(0.0))),
        "eta_num": F.avg(F.col("dy") * F.col("dy")),
        "r_cs": F.avg(F.when(F.col("dy0").isNotNull(), (F.signum("dy") == F.signum("dy0")).cast("double"))),
        "q": F.first("q"),
        "flux_range": F.max("y") - F.min("y"),
        "above_2sigma_frac": F.avg((F.col("y") > F.col("wm") + 2 * sigma).cast("double")),
        "below_2sigma_frac": F.avg((F.col("y") < F.col("wm") - 2 * sigma).cast("double")),
        "flux_trimmed_mean": F.avg(F.when((F.col("r") >= lo) & (F.col("r") < F.col("n") - lo), F.col("y"))),
        "slope_ratio": F.avg(F.when(F.col("dy").isNotNull(), (F.col("dy") > 0).cast("double"))),
        **{f"acv{k}": F.avg((F.col(f"l{k}") - F.col("m")) * d) for k in LAGS},
    }
    a = x.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])
    v, flat = F.col("v"), F.col("v") == 0
    skew = F.when((F.col("n") < 3) | flat, F.lit(0.0)).otherwise(F.col("m3") / F.nullif(F.pow(v, F.lit(1.5)), F.lit(0.0)))
    kurt = F.when((F.col("n") < 4) | flat, F.lit(0.0)).otherwise(F.col("m4") / F.nullif(v * v, F.lit(0.0)) - 3)
    k = F.when(flat, F.lit(0.0)).otherwise(F.col("kz") / F.sqrt(F.col("kz2") + TINY))
    den = F.abs("med") + TINY
    out = {
        "flux_skewness": skew, "flux_kurtosis": kurt, "phase_skewness": skew, "phase_kurtosis": kurt, "phase_amplitude": F.col("flux_range"), "phase_std": F.col("std_pop"),
        "stetson_k": k, "stetson_l": F.col("stetson_j") * k / 0.798,
        "eta_index": F.when(flat, F.lit(0.0)).otherwise(F.col("eta_num") / (2 * v + TINY)),
        "f_5_95": (F.col("q")[1] - F.col("q")[0]) / den, "f_10_90": (F.col("q")[3] - F.col("q")[2]) / den, "f_25_75": (F.col("q")[5] - F.col("q")[4]) / den,
        "flux_median": F.col("med"), **{f"acf_lag{j}": F.when(flat | (F.lit(j) >= F.col("n")), F.lit(0.0)).otherwise(F.col(f"acv{j}") / (v + 1e-20)) for j in LAGS}}
    names = [f for f in FEATURES if f not in SPECTRAL]
    a = a.withColumns(out)
    return a.select(*keys, "n", *[F.when(F.col("n") >= 5, _zero(F.col(f))).otherwise(F.lit(0.0)).alias(f) for f in names])


SPECTRAL = ("ls_period", "ls_power", "period_ratio_half", "period_ratio_double", "ls_power_2nd", "ls_period_2nd")


def spectral_features(df: DataFrame, keys: Sequence[str] = ("series_id",), value: str = "flux") -> DataFrame:
    """First and second peak of one periodogram a series."""
    seen = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy("t")
    s = seen.withColumn("_dt", F.col("t") - F.lag("t").over(w)).groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.median("_dt").alias("med_dt"))
    s = s.withColumn("pmin", F.greatest(2 * F.col("med_dt"), F.lit(0.01))).withColumn("pmax", (F.col("t1") - F.col("t0")) / 2)
    grid = per._grid(s.where("n >= 5 AND pmin < pmax"), 1 / F.col("pmax"), 1 / F.col("pmin"), 5.0)
    peaks = fast_peaks(seen, grid, keys, value=value, window=0.05).select(*keys, "period", "power", F.col("period2").alias("p2"), F.col("power2").alias("w2"))
    x = s.select(*keys, "n", "pmax").join(peaks, list(keys), "left")
    p = F.coalesce("period", "pmax")
    p2 = F.when(F.coalesce(F.col("w2"), F.lit(0.0)) > 0, F.col("p2")).otherwise(p)
    lp = F.when(p > 0, F.log10(p + TINY)).otherwise(F.lit(0.0))
    shift = math.log10(2 + TINY)
    return x.select(
        *keys, *[F.when(F.col("n") >= 5, _zero(c)).otherwise(F.lit(0.0)).alias(a) for a, c in (
            ("ls_period", lp), ("ls_power", F.coalesce("power", F.lit(0.0))), ("period_ratio_half", lp - shift), ("period_ratio_double", lp + shift),
            ("ls_power_2nd", F.coalesce("w2", F.lit(0.0))), ("ls_period_2nd", F.when(p2 > 0, F.log10(p2 + TINY)).otherwise(F.lit(0.0))))])


def features(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("t", "event_id"), value: str = "flux", error: str | None = None) -> DataFrame:
    """``(*keys, *FEATURES)``; series of fewer than five values get zeros."""
    both = shape_features(df, keys, order, value, error).join(spectral_features(df, keys, value), list(keys))
    return both.select(*keys, *FEATURES)
