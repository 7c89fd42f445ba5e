"""Queries that SQL can't express: random gaps, kernels, learned models, generated series, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import classify, gaps, metrics, registry
from ..operators import features as ft
from ..operators import period as per
from ..sources import series as src
from ..sources.config import make_seed_sequence
from .catalogue_series import r
from .experiment import run_grid, score_grid

QUERIES: dict = {}
#: Settings for short series; the functions' own defaults are the full ones.
LIGHT = {
    "gp_matern": {"restarts": 2}, "ts_mice": {"L": 3, "max_iter": 4}, "rf_impute": {"L": 3, "n_estimators": 50, "max_depth": 8},
    "gain_impute": {"epochs": 40}, "mf_impute": {"rank": 4, "max_iter": 10}, "saits": {"d_model": 16, "n_layers": 1, "epochs": 10},
}


def query(name: str):
    def add(f):
        QUERIES[name] = (f, None)
        return f

    return add


def gapped30(spark, d) -> DataFrame:
    return gaps.hash_mask(src.events_series(spark, d).drop("label"), (0.3,))


def _kernel(key: str, name: str) -> None:
    def run(spark, d):
        x = registry.impute(gapped30(spark, d), key, LIGHT.get(key, {}))
        return x.where("is_missing").select("series_id", "fraction", "event_id", r("imputed").alias("imputed"), "failed")

    QUERIES[name] = (run, None)


for _key, _name in (("spline_interp", "impute_spline"), ("gp_matern", "impute_gp"), ("ts_mice", "impute_ts_mice"), ("rf_impute", "impute_rf"), ("rnn_impute", "impute_rnn"),
                    ("gain_impute", "impute_gain"), ("mf_impute", "impute_mf"), ("gb_mice", "impute_gb_mice"), ("saits", "impute_saits")):
    _kernel(_key, _name)


@query("impute_gp_var")
def impute_gp_var(spark, d):
    x = registry.gp_with_variance(gapped30(spark, d), 1)
    return x.where("is_missing").select("series_id", "event_id", r("imputed").alias("imputed"), r("variance").alias("variance"))


@query("imputer_costs")
def imputer_costs(spark, d):
    """Runs, failures, run time and peak memory of imputers side by side; the figures differ from run to run."""
    x = gapped30(spark, d)
    each = [registry.impute(x, key, LIGHT.get(key, {})).select("method", "series_id", "failed", "runtime_s", "memory_mb") for key in ("linear_interp", "spline_interp", "mf_impute")]
    return metrics.costs(reduce(DataFrame.unionByName, each), ("series_id",))


@query("impute_mf_als")
def impute_mf_als(spark, d):
    return registry.hankel_als(gapped30(spark, d)).select("series_id", "idx", r("value", 4).alias("value"))


def _injected(name: str, variant: str) -> None:
    def run(spark, d):
        e = src.events_series(spark, d).select("series_id", "t", "flux")
        x = gaps.inject_gaps(e, (0.1, 0.3), make_seed_sequence(2), variant, shortest=2, longest=8)
        return x.groupBy("series_id", "fraction", "seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_missing").alias("n_missing"))

    QUERIES[name] = (run, None)


_injected("gap_inject_mcar", "index")
_injected("gap_inject_mask", "mask")
_injected("gap_inject_exact", "exact")


@query("generate_series")
def generate_series(spark, d):
    return signal.generate_series(spark, N=300, seeds=make_seed_sequence(4)).select("series_id", "idx", "t", r("flux").alias("flux"))


@query("experiment_grid")
def experiment_grid(spark, d):
    """Generated series through gaps, imputers and scores to a summary."""
    x = signal.generate_series(spark, N=200, dt=0.05, seeds=make_seed_sequence(2)).select("series_id", "t", "flux")
    truth = x.select("series_id").distinct().withColumns({"true_period": F.lit(1.0), "true_amplitude": F.lit(0.1)})
    grid = run_grid(x, ("mean_fill", "forward_fill", "linear_interp", "spline_interp"), (0.1, 0.3), 2)
    s = metrics.summarise(score_grid(grid, truth))
    return s.select("method", "fraction", r("rmse_mean").alias("rmse_mean"), r("prr").alias("prr"))


@query("ls_multi_term")
def ls_multi_term(spark, d):
    return per.multi_term_peaks(src.events_series(spark, d)).select("series_id", r("period").alias("period"), r("power", 4).alias("power"))


def _features(spark, d) -> DataFrame:
    e = src.events_series(spark, d)
    f = ft.shape_features(e)
    return f.withColumn("label", (F.col("series_id") % 3).cast("double"))


NAMES = ("flux_mean", "flux_std", "flux_skewness", "flux_kurtosis", "flux_mad", "eta_index", "r_cs", "acf_lag1", "flux_range")


@query("clf_rf")
def clf_rf(spark, d):
    x = _features(spark, d)
    model, _ = classify.train_forest(x, NAMES, trees=20, depth=5, folds=0)
    return model.transform(x.withColumn("weight", F.lit(1.0))).select("series_id", "label", "prediction")


@query("clf_svm")
def clf_svm(spark, d):
    x = _features(spark, d)
    return classify.train_svm(x, NAMES, n=16).transform(x).select("series_id", "label", "prediction")


SHAPES = ("flux_mean", "flux_std", "flux_skewness", "flux_kurtosis", "flux_mad", "stetson_k", "eta_index", "r_cs", "f_5_95", "f_25_75", "acf_lag1", "acf_lag2", "flux_range", "flux_median", "slope_ratio")


def _documents(spark, d) -> DataFrame:
    """Documents as series of word lengths, with their shape features and the quality label they have."""
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label")), "doc_id")
    words = known.select(F.col("doc_id").alias("series_id"), "label", F.posexplode(F.split("text", r"\s+")).alias("event_id", "word"))
    series = words.select("series_id", "label", "event_id", F.col("event_id").cast("double").alias("t"), F.length("word").cast("double").alias("flux"))
    # the label stays whole: fractional keys are compared in a normal form, by which rows are sorted again; features that aren't asked for aren't computed
    return ft.shape_features(series, ("series_id", "label")).select("series_id", F.col("label").cast("double").alias("label"), *SHAPES)


@query("clf_rf_folds")
def clf_rf_folds(spark, d):
    """Five stratified folds of a forest that tells good documents from bad ones by the shape of their word lengths."""
    fit = lambda x: classify.train_forest(x, SHAPES, trees=100, depth=12, folds=0)[0]
    return classify.cross_validated(_documents(spark, d), fit)


@query("clf_importance")
def clf_importance(spark, d):
    model, _ = classify.train_forest(_features(spark, d), NAMES, trees=10, depth=4, folds=0)
    return spark.createDataFrame([(i, n, round(v, 6)) for i, (n, v) in enumerate(classify.importance(model, NAMES))], "rank long, feature string, importance double")
