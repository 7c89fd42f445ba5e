"""Fast Lomb-Scargle spectra: samples spread on a regular grid, one FFT a block of frequencies.

The sums over a series' samples that a power needs are Fourier sums at equally spaced frequencies. A non-uniform FFT by Gaussian
gridding (Dutt & Rokhlin 1993, Greengard & Lee 2004) gives them in O(n + m log m) instead of n m, within 1e-11 of the direct
ones. Spark deals the series, and the blocks of frequencies of long ones; samples reach a block in batches, so memory is one grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("series_id",)
#: Frequencies of a block; grid points on either side of a sample; samples spread at a time.
BLOCK, REACH, CHUNK = 1 << 15, 12, 1 << 15


class Grid:
    """Sums c_j exp(-2 pi i k x_j), k = 0 .. m - 1, of weights added a batch at a time."""

    def __init__(self, m: int):
        self.modes = max(16, 1 << (m - 1).bit_length())
        self.size, self.m = 2 * self.modes, m
        self.tau = np.pi * REACH / (self.modes**2 * 2 * 1.5)
        self.cells = np.zeros(self.size, complex)

    def add(self, x: np.ndarray, weights: np.ndarray) -> None:
        """``x`` in cycles; any real numbers."""
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            w = weights[at : at + CHUNK] * np.exp(-2j * np.pi * (self.modes // 2) * part)  # the middle mode becomes mode 0
            place = (part - np.floor(part)) * self.size
            near = np.floor(place).astype(np.int64)
            steps = np.arange(1 - REACH, REACH + 1)
            away = (place - near)[:, None] - steps
            spread = np.exp(-((2 * np.pi / self.size * away) ** 2) / (4 * self.tau))
            cells = ((near[:, None] + steps) % self.size).ravel()
            for k, values in ((1, w.real), (1j, w.imag)):
                self.cells += k * np.bincount(cells, (values[:, None] * spread).ravel(), self.size)

    def sums(self) -> np.ndarray:
        k = np.arange(-(self.modes // 2), self.modes // 2)
        spectrum = np.fft.fftshift(np.fft.fft(self.cells))[self.size // 2 - self.modes // 2 : self.size // 2 + self.modes // 2] / self.size
        return (np.sqrt(np.pi / self.tau) * np.exp(k.astype(float) ** 2 * self.tau) * spectrum)[: self.m]


class Spectrum:
    """Powers at ``low + k step``, k = 0 .. m - 1, of samples added a batch at a time; floating mean, uniform weights."""

    def __init__(self, low: float, step: float, m: int):
        self.low, self.step, self.m = low, step, m
        self.one, self.two, self.values = Grid(m), Grid(m), Grid(m)
        self.n, self.sum, self.square, self.shift = 0, 0.0, 0.0, None

    def add(self, t: np.ndarray, y: np.ndarray) -> None:
        if not len(t):
            return
        if self.shift is None:
            self.shift = float(y[0])  # a power doesn't change with a constant; small numbers keep their digits
        y = y - self.shift
        turn, x = np.exp(-2j * np.pi * self.low * t), self.step * t
        self.one.add(x, turn)
        self.two.add(2 * x, turn * turn)
        self.values.add(x, y * turn)
        self.n, self.sum, self.square = self.n + len(t), self.sum + float(y.sum()), self.square + float((y * y).sum())

    def powers(self) -> np.ndarray:
        """NaN where undefined: no samples, a constant series, or sines and cosines that coincide."""
        n = max(1, self.n)
        one, two, v = self.one.sums() / n, self.two.sums() / n, self.values.sums() / n
        mean = self.sum / n
        yy = self.square / n - mean * mean
        c, s = one.real, -one.imag
        yc, ys = v.real - mean * c, -v.imag - mean * s
        cc, ss, cs = (1 + two.real) / 2 - c * c, (1 - two.real) / 2 - s * s, -two.imag / 2 - c * s
        d = cc * ss - cs * cs
        fine = (np.abs(d) > 1e-20) & (yy > 1e-14 * max(self.square / n, 1e-280)) & (self.n > 0)
        return np.where(fine, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / np.where(fine, yy * d, 1.0), np.nan)


def _dealt(df: DataFrame, grid: DataFrame, keys: Sequence[str], t: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(*keys, _b, _low, _step, _m, _first, _nf, *extra, _t, _y)``: each sample once a block of its series' frequencies."""
    g = grid.select(*keys, "t0", "fmin", "df", "nf", *extra, F.explode(F.sequence(F.lit(0), F.expr(f"CAST((nf - 1) div {BLOCK} AS INT)"))).alias("_b"))
    first = F.col("_b") * F.lit(BLOCK)
    g = g.select(*keys, "t0", "_b", (F.col("fmin") + first * F.col("df")).alias("_low"), F.col("df").alias("_step"), F.least(F.lit(BLOCK), F.col("nf") - first).cast("int").alias("_m"), first.cast("long").alias("_first"), F.col("nf").cast("long").alias("_nf"), *extra)
    samples = df.where(F.col(value).isNotNull() & F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias("_time"), F.col(value).cast("double").alias("_y"))
    # a number of partitions of its own: blocks cost far more than their bytes suggest, so small partitions must not be merged
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.join(g, list(keys)).withColumn("_t", F.col("_time") - F.col("t0")).drop("_time", "t0").repartition(n, *keys, "_b")


def _spectrum(frames: Iterator[pd.DataFrame]) -> tuple[pd.Series | None, np.ndarray, np.ndarray]:
    """(the first row, frequencies, powers) of one block."""
    head, found = None, None
    for f in frames:
        if not len(f):
            continue
        if head is None:
            head = f.iloc[0]
            found = Spectrum(float(head["_low"]), float(head["_step"]), int(head["_m"]))
        found.add(f["_t"].to_numpy(), f["_y"].to_numpy())
    if head is None:
        return None, np.empty(0), np.empty(0)
    return head, found.low + np.arange(found.m) * found.step, found.powers()


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def ls_fast(df: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, t: str = "t", value: str = "flux") -> DataFrame:
    """``(*keys, k, freq, power)`` as ``period.lomb_scargle``, by FFT. Missing values and times don't count; NULL power where it is undefined."""

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, freq, power = _spectrum(frames)
        if head is not None:
            out = {"k": int(head["_first"]) + np.arange(len(freq)), "freq": freq, "power": pd.Series(power).astype(object).where(~np.isnan(power), None)}
            yield pd.DataFrame({**{c: [v] * len(freq) for c, v in zip(keys, key)}, **out})

    dealt = _dealt(df, grid, keys, t, value)
    return dealt.groupBy(*keys, "_b").applyInPandas(run, _schema(df, keys) + ", k long, freq double, power double")


def _top(freq: np.ndarray, power: np.ndarray, first: int) -> tuple:
    """(power rounded, -k, frequency, power) of the highest peak, the lowest frequency among equals; nulls where no power is defined."""
    if np.isnan(power).all():
        return None, None, None, None
    r = np.round(power, 12)
    i = int(np.nanargmax(r))
    return float(r[i]), -(first + i), float(freq[i]), float(power[i])


_PEAK = "r{0} double, k{0} long, freq{0} double, power{0} double"


def _masked(freq: np.ndarray, power: np.ndarray, around: float, window: float) -> np.ndarray:
    return np.where(np.abs(freq - around) / (around + 1e-10) < window, 0.0, power)


def fast_peaks(df: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, t: str = "t", value: str = "flux", window: float | None = None) -> DataFrame:
    """``(*keys, freq, period, power)`` of the highest peak, and with ``window`` also ``freq2, period2, power2`` of the highest one when powers within
    that share of the first peak's frequency count as zero. No spectrum leaves a task.

    Series of one block of frequencies give both peaks at once; longer ones take a second pass with the first peak known.
    """
    kinds = _schema(df, keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, freq, power = _spectrum(frames)
        if head is None:
            return
        one = _top(freq, power, int(head["_first"]))
        whole = window is not None and head["_nf"] <= BLOCK
        two = _top(freq, _masked(freq, power, one[2], window), 0) if whole and one[2] is not None else (None,) * 4
        yield pd.DataFrame([[*key[: len(keys)], *one, *two]], columns=[*keys, "r", "k", "freq", "power", "r2", "k2", "freq2", "power2"]).astype({"k": "Int64", "k2": "Int64"})

    def rest(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, freq, power = _spectrum(frames)
        if head is not None:
            top = _top(freq, _masked(freq, power, float(head["_f1"]), window), int(head["_first"]))
            yield pd.DataFrame([[*key[: len(keys)], *top]], columns=[*keys, "r2", "k2", "freq2", "power2"]).astype({"k2": "Int64"})

    blocks = _dealt(df, grid, keys, t, value).groupBy(*keys, "_b").applyInPandas(run, f"{kinds}, {_PEAK.format(str())}, {_PEAK.format(2)}")
    best = lambda s: F.max(F.when(F.col(f"power{s}").isNotNull(), F.struct(f"r{s}", f"k{s}", f"freq{s}", f"power{s}")))
    out = blocks.groupBy(*keys).agg(best("").alias("a"), best("2").alias("b")).where("a IS NOT NULL")
    first = out.select(*keys, F.col("a.freq").alias("freq"), (1 / F.col("a.freq")).alias("period"), F.col("a.power").alias("power"), F.col("b.freq2").alias("freq2"), F.col("b.power2").alias("power2"))
    if window is None:
        return first.drop("freq2", "power2")
    long = grid.where(F.col("nf") > BLOCK).join(first.select(*keys, F.col("freq").alias("_f1")), list(keys))
    more = _dealt(df, long, keys, t, value, ("_f1",)).groupBy(*keys, "_b").applyInPandas(rest, f"{kinds}, {_PEAK.format(2)}")
    second = more.groupBy(*keys).agg(best("2").alias("c"))
    both = first.join(second, list(keys), "left").withColumns({"freq2": F.coalesce("freq2", "c.freq2"), "power2": F.coalesce("power2", "c.power2")})
    return both.select(*keys, "freq", "period", "power", "freq2", (1 / F.col("freq2")).alias("period2"), "power2")
