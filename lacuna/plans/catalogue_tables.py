"""Queries over result tables: summaries, pivots, rank tests, thresholds, classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, metrics, stats
from ..operators import features as ft
from ..operators import order as ordering
from ..sources import series as src
from . import oracles as o
from .catalogue_series import gapped, q, r
from .experiment import native_results

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def raw(spark, d) -> DataFrame:
    """Scored runs with errors rounded, so that ranks agree across engines."""
    x = native_results(gapped(spark, d))
    return x.select("method", "fraction", "seed", *[r(c, 9).alias(c) for c in ("rmse", "mae", "mse", "relative_error")])


RAW = o.RAW.replace(",\nraw AS (", ",\nraw0 AS (") + """,
raw AS (SELECT method, fraction, seed, round(rmse, 9) AS rmse, round(mae, 9) AS mae, round(mse, 9) AS mse, round(relative_error, 9) AS relative_error FROM raw0)"""
NAMES = ("rmse", "mae", "mse", "relative_error")


@query("summarise_results", f"WITH {RAW} SELECT method, fraction, " + ", ".join(f"{q(f'avg({m})')} AS {m}_mean, {q(f'stddev_samp({m})')} AS {m}_std" for m in NAMES) + " FROM raw GROUP BY ALL")
def summarise_results(spark, d):
    s = metrics.summarise(raw(spark, d), metrics=NAMES)
    return s.select("method", "fraction", *[r(f"{m}_{n}").alias(f"{m}_{n}") for m in NAMES for n in ("mean", "std")])


@query("two_level_agg", f"""WITH {RAW}, s AS (SELECT method, fraction, seed % 10 AS seed, avg(rmse) AS m FROM raw GROUP BY ALL)
SELECT method, fraction, {q('avg(m)')} AS rmse_mean, {q('stddev_pop(m)')} AS rmse_std FROM s GROUP BY ALL""")
def two_level_agg(spark, d):
    x = raw(spark, d).withColumn("seed", F.pmod(F.col("seed"), F.lit(10)))
    return metrics.two_level(x, "rmse").select("method", "fraction", r("rmse_mean").alias("rmse_mean"), r("rmse_std").alias("rmse_std"))


@query("pivot_metric", f"WITH {RAW} SELECT method, " + ", ".join(f"{q(f'avg(CASE WHEN fraction = {p} THEN rmse END)')} AS \"{p}\"" for p in (0.1, 0.3, 0.5)) + " FROM raw GROUP BY method")
def pivot_metric(spark, d):
    p = metrics.pivot(raw(spark, d), "method", "fraction", "rmse", [0.1, 0.3, 0.5])
    return p.select("method", *[r(F.col(f"`{c}`")).alias(c) for c in ("0.1", "0.3", "0.5")])


@query("boxplot_stats", f"""WITH {RAW}, b AS (SELECT method, fraction, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median, quantile_cont(rmse, 0.75) AS q3 FROM raw GROUP BY ALL),
x AS (SELECT raw.method, raw.fraction, q1, median, q3, CASE WHEN rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN rmse END AS i FROM raw JOIN b USING (method, fraction))
SELECT method, fraction, {q('first(q1)')} AS q1, {q('first(median)')} AS median, {q('first(q3)')} AS q3, {q('min(i)')} AS whisker_low, {q('max(i)')} AS whisker_high, count(*) - count(i) AS n_outliers FROM x GROUP BY ALL""")
def boxplot_stats(spark, d):
    b = metrics.boxplot(raw(spark, d), "rmse", ("method", "fraction"))
    return b.select("method", "fraction", *[r(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")


@query("method_ranking", f"WITH {RAW} SELECT method, {q('avg(rmse)')} AS rmse FROM raw WHERE fraction = 0.3 GROUP BY method ORDER BY 2")
def method_ranking(spark, d):
    s = raw(spark, d).where("fraction = 0.3").groupBy("method").agg(r(F.avg("rmse")).alias("rmse"))
    return metrics.ranking(s, "rmse")


@query("prr_curve", f"WITH {RAW} SELECT method, fraction, {q('avg((rmse < 30)::INTEGER)')} AS prr FROM raw GROUP BY ALL ORDER BY 1, 2")
def prr_curve(spark, d):
    """Share of the runs that meet a bound, by fraction: the curve behind a recovery plot."""
    hit = (F.col("rmse") < 30).cast("double")
    return raw(spark, d).groupBy("method", "fraction").agg(r(F.avg(hit)).alias("prr")).orderBy("method", "fraction")


PAIRS = RAW + """,
pr AS (SELECT a.fraction, a.method, a.seed, b.rmse AS x, a.rmse AS y FROM raw a JOIN raw b ON a.fraction = b.fraction AND a.seed = b.seed AND b.method = 'Linear-Interp' WHERE a.method <> 'Linear-Interp'),
dd AS (SELECT *, x - y AS d, round(abs(x - y), 12) AS a FROM pr WHERE x <> y),
rk AS (SELECT *, rank() OVER (PARTITION BY fraction, method ORDER BY a) + (count(*) OVER (PARTITION BY fraction, method, a) - 1) / 2.0 AS r FROM dd),
wx AS (SELECT fraction, method, count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0)::DOUBLE AS w_plus, coalesce(sum(CASE WHEN d < 0 THEN r END), 0)::DOUBLE AS w_minus FROM rk GROUP BY ALL),
cd AS (SELECT fraction, method, (avg(x) - avg(y)) / (sqrt(((count(*) - 1) * var_samp(x) + (count(*) - 1) * var_samp(y)) / (2 * count(*) - 2)) + 1e-10) AS cohens_d FROM pr GROUP BY ALL)"""


@query("wilcoxon", f"WITH {PAIRS} SELECT fraction, method, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic FROM wx")
def wilcoxon(spark, d):
    return stats.wilcoxon(stats.paired(raw(spark, d), "rmse", "Linear-Interp")).select("fraction", "method", "n", "w_plus", "w_minus", "statistic")


@query("cohens_d", f"WITH {PAIRS} SELECT fraction, method, {q('cohens_d')} AS cohens_d FROM cd")
def cohens_d(spark, d):
    return stats.cohens_d(stats.paired(raw(spark, d), "rmse", "Linear-Interp")).withColumn("cohens_d", r("cohens_d"))


@query("stats_table", f"""WITH {PAIRS} SELECT s.method, {q('s.mean')} AS mean, {q('s.std')} AS std, least(w_plus, w_minus) AS wilcoxon_stat, CASE WHEN s.method = 'Linear-Interp' THEN 0.0 ELSE {q('cohens_d')} END::DOUBLE AS cohens_d
FROM (SELECT method, avg(rmse) AS mean, stddev_samp(rmse) AS std FROM raw WHERE fraction = 0.3 GROUP BY 1) s
LEFT JOIN (SELECT * FROM wx WHERE fraction = 0.3) w ON s.method = w.method LEFT JOIN (SELECT * FROM cd WHERE fraction = 0.3) c ON s.method = c.method""")
def stats_table(spark, d):
    t = stats.stats_table(raw(spark, d), with_ci=False)
    return t.select("method", r("mean").alias("mean"), r("std").alias("std"), "wilcoxon_stat", r("cohens_d").alias("cohens_d"))


RANKS = RAW + """,
rv AS (SELECT *, round(rmse, 12) AS v FROM raw),
rr AS (SELECT *, rank() OVER (PARTITION BY fraction, seed ORDER BY v) + (count(*) OVER (PARTITION BY fraction, seed, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY fraction, seed, v) AS t FROM rv),
mr AS (SELECT fraction, method, avg(r)::DOUBLE AS mean_rank, sum(r)::DOUBLE AS rank_sum, count(*) AS n FROM rr GROUP BY ALL)"""


@query("friedman", f"""WITH {RANKS}, ti AS (SELECT fraction, sum((t * t - 1))::DOUBLE AS ties FROM rr GROUP BY 1),
x AS (SELECT fraction, max(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(rank_sum * rank_sum) AS r2 FROM mr GROUP BY 1)
SELECT fraction, n::BIGINT AS n, k::BIGINT AS k, {q('(12 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))')} AS statistic FROM x JOIN ti USING (fraction)""")
def friedman(spark, d):
    return stats.friedman(raw(spark, d), "rmse").withColumn("statistic", r("statistic"))


@query("nemenyi_ranks", f"WITH {RANKS} SELECT a.fraction, a.method AS a, b.method AS b, {q('abs(a.mean_rank - b.mean_rank) / sqrt(3 * 4 / (6.0 * a.n))')} AS q FROM mr a JOIN mr b USING (fraction) WHERE a.method <> b.method")
def nemenyi_ranks(spark, d):
    return stats.nemenyi(raw(spark, d), "rmse", with_p=False).select("fraction", "a", "b", r("q").alias("q"))


@query("nemenyi")
def nemenyi(spark, d):
    return stats.nemenyi(raw(spark, d), "rmse").select("fraction", "a", "b", r("q").alias("q"), r("p_value").alias("p_value"))


@query("decision_table")
def decision_table(spark, d):
    return stats.decision_table(raw(spark, d), "rmse", "Linear-Interp", "Mean-Fill")


PB = f"""bw0 AS (SELECT {{keys}}, seed, rmse, b, ((seed % {stats.PRIME}) * 48271 + b * 69621 + 42) % {stats.PRIME} AS h FROM {{source}}, unnest(range(0, 10000)) AS t(b) WHERE rmse IS NOT NULL),
bw1 AS (SELECT *, (((h * h + 12345) % {stats.PRIME}) * 16807 + h) % {stats.PRIME} AS h2 FROM bw0),
bw2 AS (SELECT *, (h2 * h2 + b) % {stats.PRIME} AS u FROM bw1),
bw AS (SELECT *, CASE {' '.join(f'WHEN u < {p} THEN {k}' for k, p in enumerate(stats.POISSON))} ELSE {len(stats.POISSON)} END AS w FROM bw2),
bm AS (SELECT {{keys}}, b, sum(w * rmse) / sum(w) AS m FROM bw WHERE w > 0 GROUP BY ALL),
bq AS (SELECT {{keys}}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY ALL)"""


@query("bootstrap_ci", f"WITH {RAW}, {PB.format(keys='method, fraction', source='raw')} SELECT bq.method, bq.fraction, n, {q('mean')} AS mean, {q('lo')} AS ci_lower, {q('hi')} AS ci_upper FROM bq JOIN (SELECT method, fraction, count(rmse) AS n, avg(rmse) AS mean FROM raw GROUP BY ALL) USING (method, fraction)")
def bootstrap_ci(spark, d):
    """10,000 resamples by Poisson weights."""
    b = stats.poisson_bootstrap(raw(spark, d), "rmse")
    return b.select("method", "fraction", "n", *[r(c).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


def _sets(name: str, how: str, rollup: bool) -> None:
    def run(spark, d):
        s = metrics.summarise_cube(raw(spark, d), metrics=NAMES, rollup=rollup)
        return s.select("method", "fraction", F.col("level").cast("int").alias("level"), "n", *[r(f"{m}_{k}").alias(f"{m}_{k}") for m in NAMES for k in ("mean", "std")])

    QUERIES[name] = (run, f"WITH {RAW} SELECT method, fraction, grouping_id(method, fraction)::INTEGER AS level, count(*) AS n, " + ", ".join(f"{q(f'avg({m})')} AS {m}_mean, {q(f'stddev_samp({m})')} AS {m}_std" for m in NAMES) + f" FROM raw GROUP BY {how} (method, fraction)")


_sets("summarise_cube", "CUBE", False)
_sets("summarise_rollup", "ROLLUP", True)


@query("prr_array", f"WITH {o.ES}, p AS (SELECT label, flux AS p_true, flux * (1 + (event_id % 10) / 100e0) AS p_imp FROM es WHERE flux > 0) SELECT label, {q('avg((abs(p_imp - p_true) / p_true < 0.045)::INTEGER)')} AS prr FROM p GROUP BY 1")
def prr_array(spark, d):
    x = src.events_series(spark, d).where("flux > 0").select("label", F.col("flux").alias("p_true"), (F.col("flux") * (1 + F.pmod(F.col("event_id"), F.lit(10)) / 100.0)).alias("p_imp"))
    return metrics.period_recovery_rate(x, threshold=0.045, by=("label",)).withColumn("prr", r("prr"))


@query("accuracy_loss", f"WITH {RAW}, b AS (SELECT method, fraction, avg(rmse) AS m FROM raw GROUP BY ALL) SELECT b.method, b.fraction, {q('c.m - b.m')} AS loss FROM b JOIN b c ON b.fraction = c.fraction AND c.method = 'Mean-Fill'")
def accuracy_loss(spark, d):
    b = raw(spark, d).groupBy("method", "fraction").agg(F.avg("rmse").alias("m"))
    base = b.where("method = 'Mean-Fill'").select("fraction", F.col("m").alias("base"))
    return b.join(base, "fraction").select("method", "fraction", r(metrics.accuracy_loss(F.col("base"), F.col("m"))).alias("loss"))


@query("safe_threshold", f"""WITH {RAW}, l AS (SELECT method, fraction, avg(rmse) - 30.0 AS loss FROM raw GROUP BY ALL),
p AS (SELECT *, coalesce(lag(fraction) OVER (PARTITION BY method ORDER BY fraction), 0) AS p0, coalesce(lag(loss) OVER (PARTITION BY method ORDER BY fraction), 0) AS l0 FROM l),
c AS (SELECT method, fraction, coalesce(p0 + (2.0 - l0) / nullif(loss - l0, 0) * (fraction - p0), fraction) AS p FROM p WHERE loss >= 2.0),
f AS (SELECT method, min_by(p, fraction) AS p FROM c GROUP BY 1)
SELECT m.method, coalesce({q('p')}, 9.0)::DOUBLE AS p_star FROM (SELECT DISTINCT method FROM l) m LEFT JOIN f USING (method)""")
def safe_threshold(spark, d):
    losses = raw(spark, d).groupBy("method", "fraction").agg((F.avg("rmse") - 30.0).alias("loss"))
    s = metrics.safe_threshold(losses, 2.0)
    return s.select("method", F.when(F.col("p_star") == float("inf"), F.lit(9.0)).otherwise(r("p_star")).alias("p_star"))


FEAT3 = "es2 AS (SELECT series_id, avg(flux) AS flux_mean, stddev_pop(flux) AS flux_std, max(flux) - min(flux) AS flux_range FROM es GROUP BY 1)"


@query("feature_corr", f"""WITH {o.ES}, {FEAT3}, v AS (SELECT unnest([flux_mean, flux_std, flux_range]) AS x, unnest(['flux_mean', 'flux_std', 'flux_range']) AS n, series_id FROM es2)
SELECT a.n AS a, b.n AS b, {q('corr(a.x, b.x)')} AS corr FROM v a JOIN v b USING (series_id) GROUP BY 1, 2""")
def feature_corr(spark, d):
    f = ft.shape_features(src.events_series(spark, d)).select("flux_mean", "flux_std", "flux_range")
    return metrics.correlation_matrix(f, f.columns).withColumn("corr", r("corr"))


PRED = "p AS (SELECT label AS y, CASE WHEN event_id % 4 = 0 THEN (label + 1) % 5 ELSE label END AS yhat FROM (SELECT event_id, (CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS label FROM events))"


@query("clf_metrics", f"""WITH {PRED}, cm AS (SELECT y, yhat, count(*)::DOUBLE AS n FROM p GROUP BY ALL), n AS (SELECT sum(n) AS s, sum(CASE WHEN y = yhat THEN n END) AS c FROM cm),
t AS (SELECT y AS k, sum(n) AS t FROM cm GROUP BY 1), h AS (SELECT yhat AS k, sum(n) AS p FROM cm GROUP BY 1), tp AS (SELECT y AS k, sum(n) AS tp FROM cm WHERE y = yhat GROUP BY 1),
k AS (SELECT coalesce(t.k, h.k) AS k, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM t FULL JOIN h ON t.k = h.k LEFT JOIN tp ON tp.k = coalesce(t.k, h.k))
SELECT {q('first(c / s)')} AS accuracy, {q('avg(coalesce(2 * tp / nullif(t + p, 0), 0))')} AS macro_f1,
  {q('first(c * s)  - sum(p * t)').replace('round(first(c * s)  - sum(p * t), 6)', 'round((first(c * s) - sum(p * t)) / (sqrt(first(s * s) - sum(p * p)) * sqrt(first(s * s) - sum(t * t))), 6)')} AS mcc FROM k, n""")
def clf_metrics(spark, d):
    lab = src.class_label(F.col("label"), {"click": 0, "view": 1, "error": 2, "signup": 3, "purchase": 4})
    x = src.events_series(spark, d).select("event_id", lab.alias("y"))
    x = x.withColumn("yhat", F.when(F.col("event_id") % 4 == 0, (F.col("y") + 1) % 5).otherwise(F.col("y")))
    m = classify.scores(x, "y", "yhat")
    return m.select(*[r(c).alias(c) for c in ("accuracy", "macro_f1", "mcc")])


@query("confusion_matrix", f"WITH {PRED} SELECT y::INTEGER AS y, yhat::INTEGER AS yhat, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, d):
    lab = src.class_label(F.col("label"), {"click": 0, "view": 1, "error": 2, "signup": 3, "purchase": 4})
    x = src.events_series(spark, d).select("event_id", lab.alias("y"))
    return classify.confusion(x.withColumn("yhat", F.when(F.col("event_id") % 4 == 0, (F.col("y") + 1) % 5).otherwise(F.col("y")).cast("int")), "y", "yhat")


@query("sql_functions", f"WITH {o.ES}, k AS (SELECT label, flux, row_number() OVER (PARTITION BY label ORDER BY flux) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM es) SELECT label, {q('avg(flux)')} AS trimmed FROM k WHERE i >= floor(0.05::DOUBLE * n) AND i < n - floor(0.05::DOUBLE * n) GROUP BY label")
def sql_functions(spark, d):
    """Trimmed means by distributed ranks, read from SQL (the registered aggregate ``trimmed_mean`` sorts a group in one worker)."""
    return spark.sql("SELECT label, trimmed FROM {means}", means=ordering.trimmed_mean(src.events_series(spark, d), "flux", by=("label",))).withColumn("trimmed", r("trimmed"))
