"""Kernels against independent formulas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import special
from lacuna.operators import gaps, kernels, metrics, registry
from lacuna.sources.config import make_seed_sequence, merge_configs

T = np.sort(np.random.default_rng(0).uniform(0, 10, 120))
TRUE = 1 + 0.3 * np.sin(2 * np.pi * T / 2.5)


def gapped(p=0.2, seed=1):
    gone = gaps.gap_mask(len(T), p, np.random.default_rng(seed), shortest=2, longest=5)
    return np.where(gone, np.nan, TRUE), gone


def test_spline_equals_dense_solve():
    x, y = np.array([0.0, 1, 2.5, 3, 4.2, 6]), np.array([1.0, -1, 2, 0.5, 3, 1])
    n, h = len(x), np.diff(x)
    A, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        A[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(A, b)
    at = np.linspace(0, 6, 50)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    want = (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    assert np.allclose(kernels.natural_spline(x, y, at), want)
    assert np.allclose(kernels.natural_spline(x, y, x), y)


@pytest.mark.parametrize("key", [k for k in registry.list_imputers() if registry.REGISTRY[k].kernel])
def test_kernels_keep_observed_and_fill_all(key):
    y, gone = gapped()
    small = {"rnn_impute": {"hidden_size": 6, "epochs": 3}, "gain_impute": {"epochs": 20}, "saits": {"d_model": 8, "n_layers": 1, "epochs": 5}, "gb_mice": {"n_estimators": 10, "max_iter": 2, "L": 2},
             "rf_impute": {"n_estimators": 20}, "gp_matern": {"restarts": 2}, "mf_impute": {"max_iter": 20}}
    out = registry.REGISTRY[key].kernel(T, y, gone, 2.5, np.random.default_rng(0), **small.get(key, {}))
    assert np.isfinite(out).all() and np.array_equal(out[~gone], TRUE[~gone])


@pytest.mark.parametrize("key,bound", [("spline_interp", 0.05), ("gp_matern", 0.05), ("ts_mice", 0.1), ("mf_impute", 0.2), ("rf_impute", 0.2), ("gb_mice", 0.2)])
def test_accuracy(key, bound):
    y, gone = gapped(0.15)
    opts = {"gb_mice": {"n_estimators": 20, "max_iter": 3, "L": 3}}.get(key, {})
    out = registry.REGISTRY[key].kernel(T, y, gone, 2.5, np.random.default_rng(0), **opts)
    assert np.sqrt(np.mean((out - TRUE)[gone] ** 2)) < bound


def test_lstm_gradient_by_differences():
    rng = np.random.default_rng(0)
    X, W, U, b, d = rng.normal(size=(6, 3)), rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), rng.normal(size=8), rng.normal(size=(6, 2))
    H, tape = kernels._lstm(X, W, U, b)
    grads = kernels._lstm_back(X, d, U, tape)
    for i, P in enumerate((W, U, b)):
        at = (0, 1) if P.ndim == 2 else (1,)
        P[at] += 1e-6
        up = (kernels._lstm(X, W, U, b)[0] * d).sum()
        P[at] -= 2e-6
        down = (kernels._lstm(X, W, U, b)[0] * d).sum()
        P[at] += 1e-6
        assert grads[i][at] == pytest.approx((up - down) / 2e-6, rel=1e-4)


def test_forest_single_tree_splits_exactly():
    X, y = np.arange(8.0)[:, None], np.array([0, 0, 0, 0, 5, 5, 9, 9.0])
    f = kernels.Forest(X, y, np.arange(8)[None, :], 4)
    assert np.allclose(f.predict(X), y)


@pytest.mark.parametrize("variant", ["index", "mask", "exact"])
def test_gap_mask_totals(variant):
    """At least the share asked for; more only where the last block overshoots its half, by less than a longest block."""
    for seed in range(40):
        m = gaps.gap_mask(300, 0.2, np.random.default_rng(seed), variant=variant)
        assert m.sum() == 60 if variant == "exact" else 60 <= m.sum() < 30 + 50
        m = gaps.gap_mask(300, 0.2, np.random.default_rng(seed), block_ratio=0.0, variant=variant)
        assert m.sum() == 60
        runs = np.diff(np.flatnonzero(np.diff(np.r_[0, gaps.gap_mask(4000, 0.3, np.random.default_rng(seed), block_ratio=1.0, shortest=7, variant=variant), 0])))[::2]
        assert runs.min() >= (1 if variant == "exact" else 7)
    with pytest.raises(ValueError):
        gaps.gap_mask(10, 1.0, np.random.default_rng(0))


def test_exact_masks_end_when_blocks_find_no_room():
    m = gaps.gap_mask(300, 0.999, np.random.default_rng(0), block_ratio=1.0, variant="exact")
    assert m.sum() == 300 and gaps.gap_mask(60, 0.99, np.random.default_rng(0), block_ratio=1.0, variant="exact").sum() == 59


def test_series_have_gaps_of_their_own_and_keys_may_be_null(spark):
    rows = [(s, i, float(i), float(i % 5)) for s in (None, "a", "b", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "series_id string, event_id long, t double, flux double")
    got = gaps.inject_gaps(df, [0.3], [7]).collect()
    masks = {s: tuple(r.is_missing for r in sorted((r for r in got if r.series_id == s), key=lambda r: r.t)) for s in (None, "a", "b", "c")}
    assert len(set(masks.values())) == 4 and all(60 <= sum(m) < 80 for m in masks.values())
    again = gaps.inject_gaps(df.repartition(5), [0.3], [7]).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    filled = registry.impute(gaps.inject_gaps(df, [0.3], [7]), "spline_interp").collect()
    assert len(filled) == 800 and all(r.imputed is not None for r in filled)
    assert gaps.key_seed(None) == gaps.key_seed(float("nan")) == 0 and gaps.key_seed("x") == 0x8CDC1683 and gaps.key_seed(2) == 2000


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.studentized_range_sf(3.314493, 3) == pytest.approx(0.05, abs=1e-4)
    assert special.wilcoxon_p(0, 5) == pytest.approx(2 / 32)
    assert special.wilcoxon_p(15, 5, alternative="greater") == pytest.approx(1 / 32)


def test_config_and_seeds():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert merge_configs(base, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3} and base["a"]["b"] == 1
    s = make_seed_sequence(10)
    assert len(set(s)) == 10 and s == make_seed_sequence(10) and all(0 <= x < 2**32 for x in s)
    with pytest.raises(KeyError):
        registry.get_imputer("nope")
    assert len(registry.list_imputers()) == 13


def test_adversarial_hint_is_the_mask_or_a_half(monkeypatch):
    hints = []
    whole = kernels._mlp

    def spy(x, P, name):
        if name == "d":
            hints.append(x[len(x) // 2:])
        return whole(x, P, name)

    monkeypatch.setattr(kernels, "_mlp", spy)
    y, gone = gapped()
    kernels.gain_impute(T, y, gone, 1.0, np.random.default_rng(0), epochs=3)
    assert hints and all(set(np.unique(h)) <= {0.0, 0.5, 1.0} for h in hints)
    assert all(np.isin(h, (0.5,)).sum() < len(h) / 2 and (h[gone] != 1).all() and (h[~gone] != 0).all() for h in hints)


def test_run_costs_and_parameter_names(spark):
    rows = [(s, float(i), None if i % 5 == 2 else float(np.sin(i / 3 + s))) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id long, t double, obs double").withColumn("is_missing", F.col("obs").isNull())
    kernel = registry.impute(df, "spline_interp", keys=("series_id",), order=("t",))
    window = registry.impute(df, "linear_interp", keys=("series_id",), order=("t",))
    both = kernel.select("method", "series_id", "failed", "runtime_s", "memory_mb").unionByName(window.select("method", "series_id", "failed", "runtime_s", "memory_mb"))
    got = {r.method: r for r in metrics.costs(both, ("series_id",)).collect()}
    cost = got["Spline-Interp"]
    assert cost.n_runs == 3 and cost.n_failed == 0 and 10 < cost.memory_peak < 10_000 and 0 < cost.runtime_mean <= cost.runtime_max
    assert got["Linear-Interp"].n_runs == 3 and got["Linear-Interp"].memory_peak is None
    with pytest.warns(UserWarning, match="takes no depth"):
        registry.impute(df, "gp_matern", {"depth": 3, "n_restarts": 1}, ("series_id",), ("t",))


def test_series_in_batches_are_whole_and_keys_may_be_null():
    import pyarrow as pa

    from lacuna.operators.batches import whole_series

    keys = [None] * 7 + [float("nan")] * 5 + [1.0] * 40 + [2.0] * 3 + [3.0] * 9
    whole = pa.table({"k": pa.array(keys), "v": range(len(keys))}).combine_chunks()
    got = [(t["v"].to_pylist()[a:b], str(k[0])) for t, ends, names in whole_series(whole.to_batches(max_chunksize=4), ["k"], rows=10) for (a, b), k in zip(zip(ends[:-1], ends[1:]), names)]
    assert [len(v) for v, _ in got] == [7, 5, 40, 3, 9] and [x for v, _ in got for x in v] == list(range(len(keys)))
    assert [k for _, k in got] == ["None", "nan", "1.0", "2.0", "3.0"]


def test_gaps_need_one_exchange_of_the_plain_rows(spark):
    rows = [(s, i, float(i), float(i % 5)) for s in range(6) for i in range(50)]
    df = spark.createDataFrame(rows, "series_id long, event_id long, t double, flux double")
    out = gaps.inject_gaps(df, [0.1, 0.3], [7, 8], shortest=2, longest=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    for s, p, seed in ((0, 0.1, 7), (5, 0.3, 8)):
        got = [r.is_missing for r in out.where((F.col("series_id") == s) & (F.col("fraction") == p) & (F.col("seed") == seed)).orderBy("t").collect()]
        assert got == gaps.gap_mask(50, p, np.random.default_rng([seed, round(p * 1000), gaps.key_seed(s)]), shortest=2, longest=5).tolist()


def _ragged():
    r = np.random.default_rng(5)
    for i, n in enumerate((2, 40, 61, 1, 55, 40, 70)):
        t, gone = np.sort(r.uniform(0, 30, n)), r.random(n) < 0.3
        gone[0] = False
        yield t, np.where(gone, np.nan, np.sin(t) + i), gone, 1.0


def test_networks_side_by_side_equal_single_ones():
    opts = {"hidden_size": 5, "epochs": 4}
    many = kernels.rnn_many([(*s, np.random.default_rng(i)) for i, s in enumerate(_ragged())], **opts)
    for i, (s, got) in enumerate(zip(_ragged(), many)):
        assert np.allclose(got, kernels.rnn_impute(*s, np.random.default_rng(i), **opts), rtol=0, atol=1e-12)


def test_boosted_chains_side_by_side_equal_single_trees():
    def fit(X, y):  # one series, one tree at a time
        trees, f = [], np.full(len(y), y.mean())
        for _ in range(4):
            trees.append(kernels.Forest(X, y - f, np.arange(len(y))[None, :], 3, 1.0))
            f = f + 0.3 * trees[-1].predict(X)
        return lambda Z: y.mean() + 0.3 * sum((x.predict(Z) for x in trees), np.zeros(len(Z)))

    many = kernels.gb_many([(*s, None) for s in _ragged()], L=2, n_estimators=4, max_depth=3, max_iter=2)
    for (t, y, gone, period), got in zip(_ragged(), many):
        want = kernels.chained(kernels.design(t, y, period, 2), fit, 2)[:, 0]
        assert np.array_equal(got, np.where(gone, want, y))


def test_boosted_trees_with_equal_values_and_scales_apart_equal_single_trees():
    """Few different values (ties of bins and gains) and series of 1e-3 and 1e6 in one batch: each has the trees it has alone."""
    r = np.random.default_rng(8)
    sets = []
    for n, scale in ((30, 1.0), (200, 1e6), (3, 1e-3), (120, 1e-3), (1, 5.0)):
        X = np.column_stack([r.integers(0, 4, n), r.normal(size=n), np.ones(n)]).astype(float)
        sets.append((X, scale * (X[:, 0] + r.integers(0, 3, n)), X[: max(1, n // 3)] + 0.1))
    for (X, y, Z), got in zip(sets, kernels.boosted_many(sets, 6, 4, 0.3)):
        f, total = np.full(len(y), y.mean()), np.zeros(len(Z))
        for _ in range(6):
            tree = kernels.Forest(X, y - f, np.arange(len(y))[None, :], 4, 1.0)
            f, total = f + 0.3 * tree.predict(X), total + tree.predict(Z)
        assert np.array_equal(got, y.mean() + 0.3 * total)


@pytest.mark.parametrize("name,kernel", [("impute_gb_mice", "gb_mice"), ("impute_rnn", "rnn_impute")])
def test_learned_queries_work_at_the_functions_full_settings(spark, tmp_path, name, kernel):
    from lacuna.plans import catalogue, catalogue_kernels

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 3, "view", float(np.sin(i) + i % 7), None) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    x = catalogue_kernels.gapped30(spark, str(tmp_path)).orderBy("t", "event_id").toPandas()
    y, gone = x["obs"].to_numpy(dtype=float), x["is_missing"].to_numpy()
    want = getattr(kernels, kernel)(x["t"].to_numpy(), y, gone, 1.0, np.random.default_rng([gaps.key_seed(3), gaps.key_seed(0.3)]))
    got = {r.event_id: r.imputed for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert len(got) == gone.sum() and all(abs(got[e] - v) < 2e-6 for e, v in zip(x["event_id"][gone], want[gone]))
