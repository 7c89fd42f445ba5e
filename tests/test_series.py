"""DataFrame operators on small series against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import signal
from lacuna.operators import features, gaps, impute, metrics, period, prep, registry, stats
from lacuna.plans import experiment
from lacuna.schema import SchemaError, nan_to_null, require
from lacuna.sources import series, sinks


@pytest.fixture(scope="module")
def sine(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 20, 120))
    y = 1 + 0.3 * np.sin(2 * np.pi * t / 2.5)
    return t, y, spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y))], "series_id long, event_id long, t double, flux double").cache()


def test_linear_variants(spark):
    rows = [(1, 0.5, i, float(i), v) for i, v in enumerate([None, 2.0, None, 4.0, 5.0, None])]
    df = spark.createDataFrame(rows, "series_id long, fraction double, event_id long, t double, obs double")
    got = lambda d: [r.imputed for r in d.orderBy("t").collect()]
    assert got(impute.linear(df)) == pytest.approx([1, 2, 3, 4, 5, 6])
    assert got(impute.linear(df, ends="clamp")) == pytest.approx([2, 2, 3, 4, 5, 5])
    assert got(impute.forward_fill(df)) == [2, 2, 2, 4, 5, 5]
    assert got(impute.forward_fill(df, backfill=False)) == [None, 2, 2, 4, 5, 5]
    one = df.withColumn("obs", F.when(F.col("t") == 3, F.col("obs")))
    assert got(impute.linear(one)) == [4.0] * 6
    with pytest.raises(ValueError):
        impute.linear(df, ends="wrap")


def test_gap_runs_with_trailing_run(spark):
    rows = [(1, 0.5, i, float(i), bool(m)) for i, m in enumerate([1, 0, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "series_id long, fraction double, event_id long, t double, is_missing boolean")
    assert sorted((r.start, r.length) for r in gaps.gap_runs(df).collect()) == [(0, 1), (2, 2), (5, 1)]


def test_period_found_and_power_equals_least_squares(sine):
    t, y, df = sine
    grid = period.simple_grids(df, 0.1, 1.0)
    s = period.lomb_scargle(df, grid).orderBy("k").collect()
    for r in s[::37]:
        A = np.column_stack([np.ones_like(t), np.cos(2 * np.pi * r.freq * t), np.sin(2 * np.pi * r.freq * t)])
        res = y - A @ np.linalg.lstsq(A, y, rcond=None)[0]
        assert r.power == pytest.approx(1 - (res**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-8)
    assert period.ls_peaks(df).first().period == pytest.approx(2.5, rel=0.02)


def test_perfect_reconstruction_scores(spark, sine):
    _, _, df = sine
    x = gaps.hash_mask(df, (0.3,)).withColumn("imputed", F.col("truth"))
    truth = spark.createDataFrame([(1, 2.5, 0.3)], "series_id long, true_period double, true_amplitude double")
    e = metrics.evaluate(x, truth, 0.05).first()
    assert e.rmse == 0 and e.mae == 0 and e.period_recovered == 1 and e.amplitude_error < 0.05 and 0 <= e.phase_error <= 0.5


def test_features_against_numpy(sine):
    t, y, df = sine
    f = features.features(df).first()
    d, n = np.diff(y), len(y)
    assert f.flux_mean == pytest.approx(y.mean()) and f.phase_std == pytest.approx(y.std())
    assert f.eta_index == pytest.approx((d**2).mean() / (2 * y.var() + 1e-10))
    assert f.acf_lag3 == pytest.approx(((y[:-3] - y.mean()) * (y[3:] - y.mean())).mean() / y.var())
    assert f.flux_trimmed_mean == pytest.approx(np.sort(y)[int(0.05 * n):n - int(0.05 * n)].mean())
    assert f.r_cs == pytest.approx((np.sign(d)[:-1] == np.sign(d)[1:]).mean())
    assert f.phase_skewness == f.flux_skewness and f.phase_amplitude == f.flux_range
    assert 10**f.ls_period == pytest.approx(2.5, rel=0.02)


def test_short_and_constant_series(spark):
    df = spark.createDataFrame([(1, i, float(i), 1.0) for i in range(3)] + [(2, i, float(i), 7.0) for i in range(30)], "series_id long, event_id long, t double, flux double")
    rows = {r.series_id: r for r in features.features(df).collect()}
    assert all(rows[1][c] == 0 for c in features.FEATURES)
    assert rows[2].flux_median == 7 and rows[2].stetson_k == 0 and rows[2].eta_index == 0
    assert {r.period for r in period.period_estimate(df.withColumn("obs", F.col("flux"))).collect()} == {1.0}


def test_truncate_densest_and_compat(spark):
    rows = [(1, float(i), 1.0 if o else None) for i, o in enumerate([0, 1, 1, 1, 0, 0])]
    df = spark.createDataFrame(rows, "series string, t double, obs double")
    assert [r.t for r in prep.truncate(df, 3, "densest").orderBy("t").collect()] == [1, 2, 3]
    assert [r.t for r in prep.truncate(df, 3, "densest", compat=True).orderBy("t").collect()] == [0, 1, 2]
    assert prep.truncate(df, 9, "middle").count() == 6
    with pytest.raises(ValueError):
        prep.truncate(df, 3, "best")


def test_safe_threshold(spark):
    rows = [("a", 0.1, 0.02), ("a", 0.3, 0.06), ("a", 0.5, 0.12), ("b", 0.1, 0.01), ("b", 0.3, 0.02), ("c", 0.1, 0.08)]
    got = {r.method: r.p_star for r in metrics.safe_threshold(spark.createDataFrame(rows, "method string, fraction double, loss double")).collect()}
    assert 0.1 < got["a"] < 0.3 and got["b"] == float("inf") and 0 < got["c"] <= 0.1


def test_rank_tests(spark):
    rows = [("A", 0.3, s, float(s)) for s in range(1, 31)] + [("B", 0.3, s, s + 0.5) for s in range(1, 31)]
    raw = spark.createDataFrame(rows, "method string, fraction double, seed long, rmse double")
    w = stats.wilcoxon(stats.paired(raw, "rmse", "A"), with_p=True).first()
    assert w.statistic == 0 and w.p_value < 1e-6
    same = raw.withColumn("rmse", F.lit(1.0))
    assert stats.friedman(same, "rmse").first().statistic is None
    ci = stats.bootstrap_ci(raw, "rmse", n_bootstrap=500).where("method = 'A'").first()
    assert ci.ci_lower < 15.5 < ci.ci_upper


def test_generated_series_and_grid(spark):
    x = signal.generate_series(spark, N=60, dt=0.1, seeds=(1, 2), sigma_eps=0.0)
    r = x.where("series_id = 0 AND idx = 7").first()
    assert r.flux == pytest.approx(1 + 0.1 * np.sin(2 * np.pi * 0.7))
    with pytest.raises(ValueError):
        signal.signal("sine", F.col("t"))
    with pytest.raises(ValueError):
        signal.multi_harmonic(F.col("t"), harmonics=[1, 2], amps=[1.0])
    grid = experiment.run_grid(x.select("series_id", "t", "flux"), ("mean_fill", "spline_interp"), (0.2,), 1, shortest=2, longest=4)
    out = grid.groupBy("method").agg(F.count_if(F.col("imputed").isNull()).alias("nulls"), F.count_if(F.col("is_missing")).alias("gone"), F.sum(F.abs(F.when(~F.col("is_missing"), F.col("imputed") - F.col("flux")))).alias("moved")).collect()
    assert len(out) == 2 and all(r.nulls == 0 and r.gone == 24 and r.moved == 0 for r in out)


def test_kernel_failure_falls_back_to_mean(spark):
    df = spark.createDataFrame([(1, 0.3, i, float(i), v) for i, v in enumerate([1.0, None, 3.0])], "series_id long, fraction double, event_id long, t double, obs double")
    out = registry.impute(df, "rf_impute").orderBy("t").collect()
    assert [r.imputed for r in out] == [1, 2, 3] and all(r.failed for r in out)


def test_sinks_and_schema(spark, tmp_path):
    df = spark.createDataFrame([("m_1", 0.5)], "method string, rmse double")
    assert "m\\_1 & 0.5000" in sinks.render_table(df) and sinks.render_table(df, "csv") == "method,rmse\nm_1,0.5000\n"
    with pytest.raises(ValueError):
        sinks.render_table(df, "html")
    sinks.save_results(df, str(tmp_path / "r"))
    assert series.load_results(spark, str(tmp_path / "r"), "method string, rmse double").first().rmse == 0.5
    with pytest.raises(SchemaError):
        require(df, ["absent"])
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None


def test_multi_term_period(sine):
    t, y, df = sine
    x = df.withColumn("flux", F.sin(2 * np.pi * F.col("t") / 3.0) ** 3)
    assert period.multi_term_peaks(x, 3).first().period == pytest.approx(3.0, rel=0.03)


def test_registered_functions(spark):
    from lacuna.functions.register import register_functions

    assert "frequency_grid" in register_functions(spark)
    assert spark.sql("SELECT count(*) AS n FROM frequency_grid(0.1D, 10.0D, 27.0D)").first().n == 1 + round(9.9 * 135)
    assert spark.sql("SELECT chi2_sf(3.841458820694124D, 1) AS p").first().p == pytest.approx(0.05)


def test_masks_and_splits_of_large_ids(spark):
    ids = [4_000_000_000, 2**62, -(2**62), 17]
    df = spark.createDataFrame([(i, i, float(k), 1.0, "a") for k, i in enumerate(ids)], "series_id long, event_id long, t double, flux double, label string")
    got = {r.event_id: r.is_missing for r in gaps.hash_mask(df, (0.5,)).collect()}
    assert got == {i: i * 2654435761 % 1000 < 500 for i in ids}
    blocks = {r.event_id: r.is_missing for r in gaps.hash_mask(df, (0.5,), block=2).collect()}
    assert blocks == {i: (i % 1000) * 2654435761 % 1000 < 500 for i in ids}
    first = prep.sample_per_class(df, 1).first().event_id
    assert first == min(ids, key=lambda i: (i * 2654435761 % 1000003, i))


def test_hankel_ranges_of_any_id(spark):
    ids = [40_000, 40_001, 2**40, -5]
    df = spark.createDataFrame([(s, i, float(i), None if i == 3 else float(i % 3)) for s in ids for i in range(12)], "series_id long, event_id long, t double, obs double")
    out = registry.hankel_als(df).collect()
    assert sorted((r.series_id, r.idx) for r in out) == sorted((s, i) for s in ids for i in range(12))
    r = registry._ranges(spark.createDataFrame([(s, j, j) for s in ids for j in range(5)], "series_id long, j long, k long"), 2).collect()
    assert sorted(x.start for x in r) == [0, 5, 10, 15]


def test_grid_hands_the_period_to_kernels(spark, monkeypatch):
    x = signal.generate_series(spark, N=200, dt=0.1, seeds=(1,), sigma_eps=0.0).select("series_id", "t", "flux")
    seen = experiment.period_estimate
    monkeypatch.setattr(experiment, "period_estimate", lambda df, keys: seen(df, keys).withColumn("period", F.lit(-7.0)))
    monkeypatch.setitem(registry.REGISTRY, "spline_interp", registry.Method("spline_interp", "S", kernel=_period_fill))
    out = experiment.run_grid(x, ("mean_fill", "spline_interp"), (0.2,), 1, shortest=2, longest=4).where("is_missing AND method = 'S'")
    assert {r.imputed for r in out.select("imputed").distinct().collect()} == {-7.0}


def _period_fill(t, y, gone, period, rng):
    return np.where(gone, period, y)


def test_load_dataset_skips_files_without_flux(spark, tmp_path):
    spark.range(5).selectExpr("CAST(id AS DOUBLE) AS time", "1.0D AS flux", "1 AS label").coalesce(1).write.parquet(str(tmp_path / "d" / "a"))
    spark.range(5).selectExpr("CAST(id AS DOUBLE) AS time", "1 AS label").coalesce(1).write.parquet(str(tmp_path / "d" / "b"))
    rows = series.load_dataset(spark, str(tmp_path / "d"), window=3).collect()
    assert len(rows) == 3 and all(r.flux == 1 for r in rows)


def test_poisson_bootstrap_covers_the_mean(spark):
    """Of 200 samples of 40 normal numbers, the 95 % interval holds the true mean in nearly as many; constant groups have a point."""
    rng = np.random.default_rng(2)
    rows = [("m", float(g), i + 1000 * g, float(rng.normal(5, 2))) for g in range(200) for i in range(40)]
    rows += [("flat", 0.0, i, 3.0) for i in range(9)] + [("none", 0.0, 1, None), ("text", 0.0, None, 2.0)]
    df = spark.createDataFrame(rows, "method string, fraction double, seed long, v double")
    got = stats.poisson_bootstrap(df, "v", n_bootstrap=500).collect()
    inside = [r.ci_lower <= 5 <= r.ci_upper for r in got if r.method == "m"]
    assert len(inside) == 200 and sum(inside) >= 176  # 88 of 100
    flat = next(r for r in got if r.method == "flat")
    assert (flat.n, flat.mean, flat.ci_lower, flat.ci_upper) == (9, 3.0, 3.0, 3.0) and {r.method for r in got} == {"m", "flat", "text"}
    weights = spark.range(20_000).select(stats.poisson_weight(F.col("id"), F.lit(7)).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 20_000 for r in weights}
    assert share[0] == pytest.approx(0.368, abs=0.012) and share[1] == pytest.approx(0.368, abs=0.012) and share[2] == pytest.approx(0.184, abs=0.01)


def test_cube_of_summaries(spark):
    rows = [("a", 0.1, 1.0), ("a", 0.3, 2.0), ("b", 0.1, 4.0), ("b", None, 8.0)]
    got = {(r.method, r.fraction, r.level): (r.n, r.rmse_mean) for r in metrics.summarise_cube(spark.createDataFrame(rows, "method string, fraction double, rmse double")).collect()}
    assert got[None, None, 3] == (4, 3.75) and got["a", None, 1] == (2, 1.5) and got[None, 0.1, 2] == (2, 2.5)
    assert got["b", None, 0] == (1, 8.0) and got[None, None, 2] == (1, 8.0) and len(got) == 10


@pytest.mark.parametrize("W,n", [(2, 700), (10, 900)])
def test_knn_index_equals_all_pairs(spark, W, n):
    rng = np.random.default_rng(W)
    rows = []
    for s, noise in ((1, 0.01), (2, 1.0)):
        gone = rng.random(n) < 0.06
        rows += [(s, 0.1, i, float(i), None if gone[i] else round(float(np.sin(i / 9) + noise * rng.normal()), 6)) for i in range(n)]
    rows += [(3, 0.1, i, float(i), None if i % 2 else 1.0) for i in range(30)] + [(4, 0.1, 0, 0.0, None), (None, 0.1, 0, 0.0, None), (None, 0.1, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "series_id long, fraction double, event_id long, t double, obs double")
    get = lambda x: {(r.series_id, r.event_id): r.imputed for r in x.collect()}
    plain, indexed = get(impute.knn(df, 3, W)), get(impute.knn(df, 3, W, index=True))
    assert len(plain) == len(indexed) == len(rows) and all(v is None if indexed[k] is None else v == pytest.approx(indexed[k], rel=1e-12) for k, v in plain.items())


def test_knn_index_on_a_long_smooth_series_meets_few_pairs(spark):
    n = 100_000
    t = F.col("id").cast("double")
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e4
    df = spark.range(n).select(F.lit(1).alias("series_id"), F.lit(0.1).alias("fraction"), F.col("id").alias("event_id"), t.alias("t"), F.when(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) >= 20, F.sin(t / 500) * (1 + t / n) + noise).alias("obs"))
    d = impute._neighbourhoods(df, 10, impute.KEYS, impute.ORDER).cache()
    donors = d.where("_c = 20 AND obs IS NOT NULL").select(*impute.KEYS, F.col("_d").alias("k_d"), F.col("obs").alias("k_obs"), F.col("_i").alias("k_i"))
    targets = d.where("obs IS NULL AND _c > 0").select(*impute.KEYS, "_i", "_d")
    few = targets.where("_i % 50 = 0")
    want = {r._i: r.d for r in impute._nearest(few.join(donors, list(impute.KEYS)).select(*impute.KEYS, "_i", impute._gap().alias("d"), F.col("k_i").alias("i"), F.col("k_obs").alias("f")), 1, impute.KEYS).collect()}
    found = impute._nearest(impute._indexed_pairs(targets, donors, 5, impute.KEYS), 1, impute.KEYS).collect()
    got = {r._i: r.d for r in found}
    assert len(got) == targets.count() > 1500 and all(got[i] == want[i] for i in want) and len(want) > 20


def test_window_imputers_are_dealt_by_rows_and_sorted_once_an_order(spark, monkeypatch):
    rows = [(s, p, i, float(i), (i + s) % 3 == 0, None if (i + s) % 3 == 0 else float(i * s), float(i * s)) for s in range(40) for p in (0.1, 0.3) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id long, fraction double, event_id long, t double, is_missing boolean, obs double, truth double")
    monkeypatch.setattr(impute, "TASK_ROWS", 50)
    assert impute.dealt(df).select(F.spark_partition_id()).distinct().count() > 8  # 800 rows: 16 partitions
    out = experiment.native_methods(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 3
    want = {(m, s, p, i): None for m in ("Mean-Fill", "Forward-Fill", "Linear-Interp") for s, p, i, *_ in rows}
    got = {(r.method, r.series_id, r.fraction, r.event_id): r.imputed for r in out.collect()}
    assert got.keys() == want.keys() and all(v is not None for v in got.values())
    assert got["Linear-Interp", 2, 0.1, 4] == pytest.approx(8.0) and got["Forward-Fill", 2, 0.1, 4] == 6.0


def test_als_cells_and_factors_are_never_broadcast(spark):
    rows = [(s, i, float(i), None if i % 4 == 1 else float(np.sin(i / 2) + s)) for s in range(3) for i in range(16)]
    out = registry.hankel_als(spark.createDataFrame(rows, "series_id long, event_id long, t double, obs double"), rank=2)
    got = out.collect()  # adaptive execution would broadcast such small factors
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all(f"SortMergeJoin [{c}#" in plan for c in ("u", "v", "series_id")) and len(got) == 48
    assert np.mean([abs(r.value - (np.sin(r.idx / 2) + r.series_id)) for r in got]) < 0.2


def test_als_blocks_grow_with_the_cells_and_keep_series_whole(spark, monkeypatch):
    monkeypatch.setattr(registry, "CELLS", 500)
    monkeypatch.setattr(registry, "LONG", 40)
    rows = [(s, i, float(i), None if i % 4 == 1 else float(np.sin(i / 2) + s)) for s in range(120) for i in range(100 if s == 7 else 16 + s % 5)] + [(500, 0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id long, event_id long, t double, obs double")
    cells, blocks = registry._numbered(df, "obs")
    got = cells.collect()
    assert blocks == -(-len(got) // 500) > 20
    of = {}
    for r in got:
        of.setdefault(r.series_id, set()).update((r.u % blocks, r.v % blocks))
    assert all(len(b) == 1 for s, b in of.items() if s != 7) and len(of[7]) == min(51, blocks) and len({b for s, x in of.items() if s != 7 for b in x}) > blocks / 2
    for c in ("u", "v"):  # no number of two series
        assert len({(r[c], r.series_id) for r in got}) == len({r[c] for r in got})
        assert len({(r.series_id, r["j" if c == "u" else "k"]) for r in got}) == len({r[c] for r in got})
    out = registry.hankel_als(df, rank=2).collect()
    # from its random start ALS misses some series by far, whatever their numbers
    assert len(out) == len(rows) - 1 and np.median([abs(r.value - (np.sin(r.idx / 2) + r.series_id)) for r in out]) < 2
