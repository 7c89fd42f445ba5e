"""Spectra by FFT against direct sums; peaks of blocks, ties, gaps, long series."""

import numpy as np
import pytest

from lacuna.operators import period as per
from lacuna.operators import spectra


def direct(t, y, f):
    x = 2 * np.pi * f[:, None] * t[None, :]
    c, s, y = np.cos(x), np.sin(x), y - y.mean()
    C, S = c.mean(1), s.mean(1)
    yc, ys, cc, ss, cs = (y * c).mean(1), (y * s).mean(1), (c * c).mean(1) - C * C, (s * s).mean(1) - S * S, (c * s).mean(1) - C * S
    return (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / ((y * y).mean() * (cc * ss - cs**2))


@pytest.mark.parametrize("n,m,offset", [(6, 40, 0.0), (70, 1500, 1e5), (3000, 9000, -20.0)])
def test_powers_equal_direct_sums(n, m, offset):
    rng = np.random.default_rng(n)
    t = np.sort(rng.uniform(0, 50, n))
    y = offset + rng.normal(size=n) + np.sin(2 * np.pi * t / 1.7)
    s = spectra.Spectrum(0.1, 0.004, m)
    for part in np.array_split(np.arange(n), 4):
        s.add(t[part], y[part])
    assert np.abs(s.powers() - direct(t, y, 0.1 + 0.004 * np.arange(m))).max() < 1e-6
    flat = spectra.Spectrum(0.1, 0.004, m)
    flat.add(t, np.full(n, 3.25))
    assert np.isnan(flat.powers()).all() and np.isnan(spectra.Spectrum(0.1, 0.1, 5).powers()).all()


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, (n, p) in {None: (60, 2.5), "a": (400, 0.7), "b": (1500, 3.1)}.items():
        t = np.sort(rng.uniform(0, 40, n))
        y = np.sin(2 * np.pi * t / p) + 0.4 * np.sin(2 * np.pi * t / 0.31) + 0.05 * rng.normal(size=n)
        rows += [(k, float(a), None if i % 9 == 0 else float(b)) for i, (a, b) in enumerate(zip(t, y))]
    rows += [("flat", float(i), 1.0) for i in range(20)] + [("one", 1.0, 1.0), ("none", 2.0, None)]
    return spark.createDataFrame(rows, "series_id string, t double, flux double").repartition(4).cache()


@pytest.mark.parametrize("block", [1 << 15, 100])
def test_peaks_equal_those_of_the_direct_spectrum(series, monkeypatch, block):
    monkeypatch.setattr(spectra, "BLOCK", block)
    seen = series.where("series_id IS NOT NULL")
    grid = per.simple_grids(seen, 0.1, 5.0)
    power = per.lomb_scargle(seen, grid)
    first = per.peak(power)
    want = {r.series_id: (r.freq, r.power) for r in first.collect()}
    second = {r.series_id: (r.freq, r.power) for r in per.second_peak(power, first).collect()}
    got = {r.series_id: r for r in spectra.fast_peaks(seen, grid, window=0.05).collect()}
    assert set(got) == set(want) == {"a", "b"}
    for k in got:
        assert (got[k].freq, got[k].power) == pytest.approx(want[k], abs=1e-9) and (got[k].freq2, got[k].power2) == pytest.approx(second[k], abs=1e-9)
        assert got[k].period2 == pytest.approx(0.31, rel=0.02)
    fast = {(r.series_id, r.k): r.power for r in spectra.ls_fast(seen, grid).collect()}
    slow = {(r.series_id, r.k): r.power for r in power.collect()}
    assert set(fast) == set(slow) and all(v is None if fast[k] is None else v == pytest.approx(fast[k], abs=1e-9) for k, v in slow.items() if k[0] != "flat")


def test_a_series_of_a_hundred_thousand_samples(spark):
    from pyspark.sql import functions as F

    t = F.col("id") * 0.02 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e6
    long = spark.range(100_000).select(F.lit(1).alias("series_id"), t.alias("t"), (F.sin(2 * np.pi * t / 3.7) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1e4).alias("flux"))
    got = spectra.fast_peaks(long, per.simple_grids(long, 0.1, 25.0)).collect()
    assert len(got) == 1 and got[0].period == pytest.approx(3.7, rel=1e-3)
