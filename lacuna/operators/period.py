"""Lomb-Scargle periodograms and what is read from them, in DataFrame operations.

In ``lomb_scargle`` every (sample, frequency) pair is one row of a generated stream that whole-stage code sums at once; power is the closed
form of the floating-mean periodogram (Zechmeister & Kuerster 2009, uniform weights). What needs only peaks takes them from ``spectra``, by FFT.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectra import fast_peaks

KEYS = ("series_id",)
TWO_PI = 6.283185307179586
#: Frequencies of a series that one task sums together.
BLOCK = 128


def frequency_count(baseline: Column, fmin: Column | float, fmax: Column | float, per_peak: float = 5.0) -> Column:
    """1 + round((fmax - fmin) * per_peak * baseline), at least 1."""
    return F.greatest(F.lit(1), (1 + F.round((fmax - fmin) * per_peak * baseline)).cast("int"))


def grids(df: DataFrame, fmin: Column | float = 0.1, fmax: Column | float = 10.0, per_peak: float = 5.0, keys: Sequence[str] = KEYS, t: str = "t") -> DataFrame:
    """``(*keys, t0, t1, n, fmin, df, nf)``: each series' frequency grid; ``fmin`` and ``fmax`` may use n, t0, t1 and med_dt."""
    w = Window.partitionBy(*keys).orderBy(t)
    steps = df.withColumn("_dt", F.col(t) - F.lag(t).over(w))
    s = steps.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n"), F.median("_dt").alias("med_dt"))
    return _grid(s, fmin, fmax, per_peak)


def simple_grids(df: DataFrame, fmin: float = 0.1, fmax: float = 10.0, per_peak: float = 5.0, keys: Sequence[str] = KEYS, t: str = "t") -> DataFrame:
    """As ``grids``, for bounds that need no median step: a single aggregation."""
    return _grid(df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n")), F.lit(fmin), F.lit(fmax), per_peak)


def _grid(s: DataFrame, fmin: Column | float, fmax: Column | float, per_peak: float) -> DataFrame:
    low, high = (F.lit(x) if isinstance(x, float) else x for x in (fmin, fmax))
    s = s.withColumn("fmin", low).withColumn("fmax", high).where("t1 > t0 AND fmax >= fmin")
    base = F.col("t1") - F.col("t0")
    return s.withColumn("df", 1 / (per_peak * base)).withColumn("nf", frequency_count(base, F.col("fmin"), F.col("fmax"), per_peak))


def lomb_scargle(df: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, t: str = "t", value: str = "flux") -> DataFrame:
    """``(*keys, k, freq, power)``; NULL power where it is undefined (constant series)."""
    g = grid.select(*keys, "fmin", "df", "nf")
    pairs = df.where(F.col(value).isNotNull()).select(*keys, F.col(t).alias("_t"), F.col(value).alias("_y")).join(g, list(keys))
    # dealt by series and block of frequencies before the pairs arise: the sums then need no further exchange, and a hot
    # series is spread over its blocks
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"CAST((nf - 1) div {BLOCK} AS INT)"))).alias("b")
    pairs = pairs.select(*keys, "_t", "_y", "fmin", "df", "nf", blocks).repartition(n, *keys, "b")
    first = F.col("b") * BLOCK
    pairs = pairs.select(*keys, "_t", "_y", "fmin", "df", "b", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col("nf") - 1))).alias("k"))
    f = F.col("fmin") + F.col("k") * F.col("df")
    x = F.lit(TWO_PI) * f * F.col("_t")
    p = pairs.select(*keys, "b", "k", f.alias("freq"), "_y", F.cos(x).alias("c"), F.sin(x).alias("s"))
    a = p.groupBy(*keys, "b", "k").agg(
        F.min("freq").alias("freq"), F.avg("_y").alias("y"), F.avg(F.col("_y") * F.col("_y")).alias("yy"), F.avg("c").alias("c"), F.avg("s").alias("s"),
        F.avg(F.col("_y") * F.col("c")).alias("yc"), F.avg(F.col("_y") * F.col("s")).alias("ys"),
        F.avg(F.col("c") * F.col("c")).alias("cc"), F.avg(F.col("s") * F.col("s")).alias("ss"), F.avg(F.col("c") * F.col("s")).alias("cs"))
    return a.select(*keys, "k", "freq", power().alias("power"))


def power() -> Column:
    """Power from the averages y, yy, c, s, yc, ys, cc, ss, cs of one frequency."""
    col = F.col
    YY, YC, YS = col("yy") - col("y") * col("y"), col("yc") - col("y") * col("c"), col("ys") - col("y") * col("s")
    CC, SS, CS = col("cc") - col("c") * col("c"), col("ss") - col("s") * col("s"), col("cs") - col("c") * col("s")
    D = CC * SS - CS * CS
    return (SS * YC * YC + CC * YS * YS - 2 * CS * YC * YS) / F.when((F.abs(YY) > 1e-300) & (F.abs(D) > 1e-300), YY * D)


def peak(spectrum: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(*keys, freq, period, power)`` of the highest peak, the lowest frequency among equals."""
    best = spectrum.where("power IS NOT NULL").groupBy(*keys).agg(F.max(F.struct(F.round("power", 12).alias("r"), -F.col("k"), F.col("freq").alias("freq"), F.col("power").alias("power"))).alias("b"))
    return best.select(*keys, F.col("b.freq").alias("freq"), (1 / F.col("b.freq")).alias("period"), F.col("b.power").alias("power"))


def second_peak(spectrum: DataFrame, first: DataFrame, window: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """The highest peak apart from the first: powers within ``window`` of it count as zero."""
    f1 = first.select(*keys, F.col("freq").alias("_f1"))
    near = F.abs(F.col("freq") - F.col("_f1")) / (F.col("_f1") + 1e-10) < window
    masked = spectrum.join(f1, list(keys)).withColumn("power", F.when(near, F.lit(0.0)).otherwise(F.col("power"))).drop("_f1")
    return peak(masked, keys)


def period_estimate(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "obs", fmin: float = 0.1, fmax: float = 10.0, least: int = 10) -> DataFrame:
    """``(*keys, period)`` from the observed samples; 1.0 with fewer than ``least`` of them or no usable spectrum."""
    seen = df.where(F.col(value).isNotNull())
    enough = simple_grids(seen, fmin, fmax, keys=keys).where(F.col("n") >= least)
    best = fast_peaks(seen, enough, keys, value=value).select(*keys, "period")
    return df.select(*keys).distinct().join(best, list(keys), "left").withColumn("period", F.coalesce("period", F.lit(1.0)))


def ls_peaks(df: DataFrame, min_period: float | None = None, max_period: float | None = None, per_peak: float = 5.0, keys: Sequence[str] = KEYS, value: str = "flux") -> DataFrame:
    """``(*keys, period, power)`` over periods from max(2 median step, 0.01) to half the baseline.

    Fewer than five samples: half the baseline (1.0 for one sample) and power 0; an empty period range: its upper end.
    """
    seen = df.where(F.col(value).isNotNull())
    pmin = F.lit(min_period) if min_period else F.greatest(2 * F.col("med_dt"), F.lit(0.01))
    pmax = F.lit(max_period) if max_period else (F.col("t1") - F.col("t0")) / 2
    w = Window.partitionBy(*keys).orderBy("t")
    s = seen.withColumn("_dt", F.col("t") - F.lag("t").over(w)).groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.median("_dt").alias("med_dt"))
    s = s.withColumn("pmin", pmin).withColumn("pmax", pmax)
    usable = s.where("n >= 5 AND pmin < pmax")
    best = fast_peaks(seen, _grid(usable, 1 / F.col("pmax"), 1 / F.col("pmin"), per_peak), keys, value=value)
    short = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("t1") - F.col("t0"))
    fallback = F.when(F.col("n") < 5, F.when(F.col("n") <= 1, short).otherwise(short / 2)).otherwise(F.col("pmax"))
    return s.select(*keys, fallback.alias("_fb")).join(best, list(keys), "left").select(
        *keys, F.coalesce("period", "_fb").alias("period"), F.coalesce("power", F.lit(0.0)).alias("power"), F.coalesce("freq", 1 / F.col("_fb")).alias("freq"))


def recovery_bounds(df: DataFrame, keys: Sequence[str] = KEYS, fmax: float = 10.0) -> DataFrame:
    """Grids from half the inverse of the last time (not the baseline) to ``fmax``."""
    s = df.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    return _grid(s, F.lit(0.5) / F.when(F.col("t1") > 0, F.col("t1")), F.lit(fmax), 5.0)


def period_recovery(df: DataFrame, truth: DataFrame, tol: float = 0.01, keys: Sequence[str] = KEYS, value: str = "imputed") -> DataFrame:
    """``(*keys, period, period_rel_err, period_recovered)`` against ``truth (series_id, true_period)``."""
    best = fast_peaks(df, recovery_bounds(df, keys), keys, value=value)
    on = [c for c in truth.columns if c in keys]
    x = df.select(*keys).distinct().join(best, list(keys), "left").join(truth, on)
    err = F.abs(F.col("period") - F.col("true_period")) / (F.col("true_period") + 1e-8)
    return x.select(*keys, "freq", "period", err.alias("period_rel_err"), F.when(F.coalesce(err < tol, F.lit(False)), 1).otherwise(0).alias("period_recovered"))


def multi_term_peaks(df: DataFrame, n_terms: int = 2, per_peak: float = 5.0, keys: Sequence[str] = KEYS, value: str = "flux") -> DataFrame:
    """``(*keys, period, power)`` of the best fit of a constant and ``n_terms`` harmonics, over the grid of ``ls_peaks``.

    A least-squares problem per frequency has no closed sum of a few averages, so this is a grouped NumPy kernel; frequencies are solved in
    blocks of bounded memory. Series without a usable grid get NULL.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", period double, power double"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[value]).sort_values("t")
        t, y = frame["t"].to_numpy(dtype=float), frame[value].to_numpy(dtype=float)
        best = (None, None)
        low, high = (max(2 * np.median(np.diff(t)), 0.01), (t[-1] - t[0]) / 2) if len(t) >= 5 else (1.0, 0.0)
        if low < high and np.var(y) > 0:
            n = 1 + int(np.floor((1 / low - 1 / high) * per_peak * (t[-1] - t[0]) + 0.5))
            f = 1 / high + np.arange(n) / (per_peak * (t[-1] - t[0]))
            total, top = ((y - y.mean()) ** 2).sum(), -1.0
            for block in np.array_split(f, max(1, n * len(t) * (2 * n_terms + 1) // 2_000_000)):
                x = 2 * np.pi * block[:, None] * t[None, :]
                A = np.stack([np.ones_like(x), *[g(k * x) for k in range(1, n_terms + 1) for g in (np.sin, np.cos)]], axis=2)
                G = A.transpose(0, 2, 1) @ A + 1e-9 * np.eye(2 * n_terms + 1)
                b = A.transpose(0, 2, 1) @ (y - y.mean())
                gain = (b * np.linalg.solve(G, b[:, :, None])[:, :, 0]).sum(axis=1) / total
                k = int(gain.argmax())
                if gain[k] > top:
                    top, best = gain[k], (float(1 / block[k]), float(gain[k]))
        return pd.DataFrame([[*key, *best]], columns=[*keys, "period", "power"])

    return df.select(*keys, "t", value).groupBy(*keys).applyInPandas(run, schema)
