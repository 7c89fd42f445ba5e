"""Noise-free signal models as column expressions over a time column."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def sinusoidal(t: Column, A: float = 0.1, P0: float = 1.0, phi0: float = 0.0, mu0: float = 1.0) -> Column:
    return F.lit(mu0) + F.lit(A) * F.sin(TWO_PI * t / P0 + phi0)


def multi_harmonic(t: Column, A: float = 0.1, P0: float = 1.0, phi0: float = 0.0, mu0: float = 1.0, harmonics: Sequence[int] | None = None, amps: Sequence[float] | None = None, phases: Sequence[float] | None = None) -> Column:
    h = list(harmonics or [1, 2, 3])
    a = list(amps or [A / 2**k for k in range(len(h))])
    p = list(phases or [phi0] * len(h))
    if not len(h) == len(a) == len(p):
        raise ValueError("harmonics, amplitudes and phases must have equal lengths")
    out = F.lit(mu0)
    for hk, ak, pk in zip(h, a, p):
        out = out + F.lit(ak) * F.sin(TWO_PI * hk * t / P0 + pk)
    return out


def _dip(phase: Column, centre: float, depth: float, duration: float) -> Column:
    """Trapezoid: full depth inside 80 % of the half-width, linear ramps outside."""
    away = F.abs(phase - centre)
    away = F.least(away, 1 - away)
    half = duration / 2
    ramp = 0.2 * half
    return F.when(away < half - ramp, F.lit(depth)).when(away < half, depth * (half - away) / ramp).otherwise(F.lit(0.0))


def eclipsing_binary(t: Column, A: float = 0.1, P0: float = 1.0, phi0: float = 0.0, mu0: float = 1.0, depth: float = 0.08, duration: float = 0.15, secondary: float = 0.03) -> Column:
    phase = F.pmod(t / P0 + phi0 / TWO_PI, F.lit(1.0))
    return F.lit(mu0) + 0.5 * A * F.cos(2 * TWO_PI * t / P0) - _dip(phase, 0.0, depth, duration) - _dip(phase, 0.5, secondary, duration * 0.7)


def sawtooth(t: Column, A: float = 0.1, P0: float = 1.0, phi0: float = 0.0, mu0: float = 1.0, n_harmonics: int = 10) -> Column:
    out = F.lit(mu0)
    for k in range(1, n_harmonics + 1):
        out = out + F.lit((-1) ** (k + 1) * 2 * A / (math.pi * k)) * F.sin(TWO_PI * k * t / P0 + phi0)
    return out


MODELS: dict[str, Callable[..., Column]] = {"sinusoidal": sinusoidal, "multi_harmonic": multi_harmonic, "eclipsing_binary": eclipsing_binary, "sawtooth": sawtooth}


def signal(model: str, t: Column, custom: Callable[[Column], Column] | None = None, **params) -> Column:
    if model == "custom":
        if custom is None:
            raise ValueError("the custom model needs a function of the time column")
        return custom(t)
    if model not in MODELS:
        raise ValueError(f"unknown signal model {model!r}")
    return MODELS[model](t, **params)


def generate_series(spark: SparkSession, N: int = 1323, dt: float = 0.0204, sigma_eps: float = 0.02, seeds: Sequence[int] = (0,), model: str = "sinusoidal", custom: Callable[[Column], Column] | None = None, **params) -> DataFrame:
    """``(series_id, idx, t, ideal_flux, noise, flux)``: one series a seed, Gaussian noise from NumPy's PCG64.

    The noise of a series is drawn whole by its own generator, so it depends on neither partitioning nor
    the other seeds.
    """
    ids = spark.createDataFrame([(i, int(s)) for i, s in enumerate(seeds)], "series_id long, seed long")

    def noise(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"series_id": r.series_id, "idx": np.arange(N, dtype=np.int32), "noise": np.random.default_rng(r.seed).normal(0.0, sigma_eps, N)}) for r in frame.itertuples()]
        return pd.concat(out)

    rows = ids.groupBy("series_id").applyInPandas(noise, "series_id long, idx int, noise double")
    t = F.col("idx") * F.lit(dt)
    clean = rows.withColumn("t", t).withColumn("ideal_flux", signal(model, F.col("t"), custom, **params))
    return clean.select("series_id", "idx", "t", "ideal_flux", "noise", (F.col("ideal_flux") + F.col("noise")).alias("flux"))


def phase_fold(t: Column, period: Column | float) -> Column:
    """Phase in [0, 1)."""
    p = F.lit(period) if isinstance(period, (int, float)) else period
    return F.pmod(t, p) / p
