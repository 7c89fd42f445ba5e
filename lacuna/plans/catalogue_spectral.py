"""Queries: periodograms, period and phase scores, the 35 features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import gaps, impute, metrics
from ..operators import period as per
from ..operators.spectra import fast_peaks, ls_fast
from ..schema import FEATURES
from ..sources import series as src
from . import oracles as o
from .catalogue_series import gapped, q, r

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _grid(source: str, keys: str, fmin: str, fmax: str, value: str = "flux", where: str = "true") -> str:
    return f"""SELECT {keys}, {fmin} AS fmin, 1 / (5.0 * (t1 - t0)) AS df, greatest(1, 1 + round(({fmax} - {fmin}) * 5.0 * (t1 - t0)))::BIGINT AS nf
  FROM (SELECT {keys}, min(t) AS t0, max(t) AS t1, count(*) AS n, median(dt) AS md FROM (SELECT *, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS dt FROM {source} WHERE {value} IS NOT NULL) GROUP BY {keys}) WHERE t1 > t0 AND {where}"""


RANGE = dict(fmin="(1 / ((t1 - t0) / 2))", fmax="(1 / greatest(2 * md, 0.01::DOUBLE))", where="n >= 5 AND greatest(2 * md, 0.01) < (t1 - t0) / 2")
SP1 = o.ES + "," + o.lomb_scargle("es", "series_id", _grid("es", "series_id", "0.1::DOUBLE", "1.0::DOUBLE"))
SPR = o.ES + "," + o.lomb_scargle("es", "series_id", _grid("es", "series_id", **RANGE)) + "," + o.peak("sp", "series_id")
SECOND = SPR + """,
sp2 AS (SELECT sp.series_id, sp.k, sp.freq, CASE WHEN abs(sp.freq - pk.freq) / (pk.freq + 1e-10) < 0.05 THEN 0 ELSE sp.power END AS power FROM sp JOIN pk USING (series_id)),""" + o.peak("sp2", "series_id", "pk2")


@query("lomb_scargle", f"WITH {SP1} SELECT series_id, k, {q('freq')} AS freq, {q('power', 4)} AS power FROM sp")
def lomb_scargle(spark, d):
    e = src.events_series(spark, d)
    s = per.lomb_scargle(e, per.simple_grids(e, 0.1, 1.0))
    return s.select("series_id", F.col("k").cast("long").alias("k"), r("freq").alias("freq"), r("power", 4).alias("power"))


@query("ls_fast", f"WITH {SP1} SELECT series_id, k, {q('freq')} AS freq, {q('power', 6)} AS power FROM sp")
def ls_fast_(spark, d):
    """The same spectra by FFT, to the sixth digit."""
    e = src.events_series(spark, d)
    s = ls_fast(e, per.simple_grids(e, 0.1, 1.0))
    return s.select("series_id", "k", r("freq").alias("freq"), r("power", 6).alias("power"))


G3 = o.G.replace("(VALUES (100), (300), (500))", "(VALUES (300))")
PE = G3 + "," + o.lomb_scargle("g", "series_id, fraction", _grid("g", "series_id, fraction", "0.1::DOUBLE", "10.0::DOUBLE", "obs", "n >= 10"), "obs") + "," + o.peak("sp", "series_id, fraction")


@query("period_estimate", f"WITH {PE} SELECT s.series_id, s.fraction, {q('coalesce(period, 1)')} AS period FROM (SELECT DISTINCT series_id, fraction FROM g) s LEFT JOIN pk USING (series_id, fraction)")
def period_estimate(spark, d):
    g = gaps.hash_mask(src.events_series(spark, d), (0.3,))
    return per.period_estimate(g, ("series_id", "fraction")).withColumn("period", r("period"))


@query("ls_peak", f"WITH {SPR} SELECT series_id, {q('period')} AS period, {q('power', 4)} AS power FROM pk")
def ls_peak(spark, d):
    return per.ls_peaks(src.events_series(spark, d)).select("series_id", r("period").alias("period"), r("power", 4).alias("power"))


@query("ls_second_peak", f"WITH {SECOND} SELECT series_id, {q('period')} AS period, {q('power', 4)} AS power FROM pk2")
def ls_second_peak(spark, d):
    e = src.events_series(spark, d)
    g = per.grids(e, F.lit(2.0) / (F.col("t1") - F.col("t0")), 1 / F.greatest(2 * F.col("med_dt"), F.lit(0.01)))
    p = fast_peaks(e, g, window=0.05).select("series_id", F.col("period2").alias("period"), F.col("power2").alias("power"))
    return p.select("series_id", r("period").alias("period"), r("power", 4).alias("power"))


REC = G3 + "," + o.linear() + "," + o.lomb_scargle("lin", "series_id, fraction", "SELECT series_id, fraction, 0.5 / t1 AS fmin, 1 / (5.0 * (t1 - t0)) AS df, greatest(1, 1 + round((10.0 - 0.5 / t1) * 5.0 * (t1 - t0)))::BIGINT AS nf FROM (SELECT series_id, fraction, min(t) AS t0, max(t) AS t1 FROM lin GROUP BY 1, 2)", "imputed") + "," + o.peak("sp", "series_id, fraction")
PHASE = REC + """,
ps AS (SELECT series_id, fraction, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(s * imputed) AS sy, sum(c * imputed) AS cy
  FROM (SELECT series_id, fraction, imputed, sin(2 * pi() * freq * t) AS s, cos(2 * pi() * freq * t) AS c FROM lin JOIN pk USING (series_id, fraction)) GROUP BY 1, 2),
pb AS (SELECT series_id, fraction, (cc * sy - sc * cy) / (ss * cc - sc * sc) AS bs, (ss * cy - sc * sy) / (ss * cc - sc * sc) AS bc FROM ps),
pa AS (SELECT series_id, fraction, abs(atan2(bs, bc)) AS a, abs(atan2(bc, bs)) AS b FROM pb),
ph AS (SELECT series_id, fraction, least(a, 2 * pi() - a) / (2 * pi()) AS phase_error, least(b, 2 * pi() - b) / (2 * pi()) AS phase_error_corrected FROM pa)"""


def _linear30(spark, d):
    return impute.linear(gaps.hash_mask(src.events_series(spark, d), (0.3,)))


def _truth(df, period: float = 1.0, amplitude: float = 20.0):
    return df.select("series_id").distinct().withColumns({"true_period": F.lit(period), "true_amplitude": F.lit(amplitude)})


@query("period_recovery", f"WITH {REC} SELECT series_id, fraction, {q('period')} AS period, {q('abs(period - 1.0) / (1.0 + 1e-8)')} AS period_rel_err, (abs(period - 1.0) / (1.0 + 1e-8) < 0.5)::INTEGER AS period_recovered FROM pk")
def period_recovery(spark, d):
    x = _linear30(spark, d)
    p = per.period_recovery(x, _truth(x).drop("true_amplitude"), 0.5, impute.KEYS)
    return p.select("series_id", "fraction", r("period").alias("period"), r("period_rel_err").alias("period_rel_err"), "period_recovered")


@query("metric_phase", f"WITH {PHASE} SELECT series_id, fraction, {q('phase_error', 4)} AS phase_error, {q('phase_error_corrected', 4)} AS phase_error_corrected FROM ph")
def metric_phase(spark, d):
    x = _linear30(spark, d)
    best = fast_peaks(x, per.recovery_bounds(x, impute.KEYS), impute.KEYS, value="imputed")
    p = metrics.phase_error(x, best)
    return p.select("series_id", "fraction", r("phase_error", 4).alias("phase_error"), r("phase_error_corrected", 4).alias("phase_error_corrected"))


@query("evaluate_imputation", f"""WITH {PHASE}, pw AS (SELECT series_id, fraction, sqrt(avg(pow(imputed - truth, 2))) AS rmse, avg(abs(imputed - truth)) AS mae, avg(pow(imputed - truth, 2)) AS mse, avg(abs(imputed - truth) / (abs(truth) + 1e-8)) AS relative_error FROM lin WHERE is_missing GROUP BY 1, 2),
am AS (SELECT series_id, fraction, abs((max(imputed) - min(imputed)) / 2 - 20.0) / (20.0 + 1e-8) AS amplitude_error FROM lin GROUP BY 1, 2)
SELECT series_id, fraction, {q('rmse')} AS rmse, {q('mae')} AS mae, {q('mse')} AS mse, {q('relative_error')} AS relative_error, (abs(period - 1.0) / (1.0 + 1e-8) < 0.5)::INTEGER AS period_recovered,
  {q('abs(period - 1.0) / (1.0 + 1e-8)')} AS period_rel_err, {q('amplitude_error')} AS amplitude_error, {q('phase_error', 4)} AS phase_error FROM pw JOIN pk USING (series_id, fraction) JOIN am USING (series_id, fraction) JOIN ph USING (series_id, fraction)""")
def evaluate_imputation(spark, d):
    x = _linear30(spark, d)
    e = metrics.evaluate(x, _truth(x), 0.5)
    return e.select("series_id", "fraction", *[r(c).alias(c) for c in ("rmse", "mae", "mse", "relative_error")], "period_recovered", r("period_rel_err").alias("period_rel_err"), r("amplitude_error").alias("amplitude_error"), r("phase_error", 4).alias("phase_error"))


_acf = ", ".join(f"avg((l{k} - m) * (y - m)) AS a{k}" for k in ft.LAGS)
SHAPE = o.ES + f""",
f0 AS (SELECT series_id, event_id, t, flux AS y, row_number() OVER w - 1 AS i, count(*) OVER p AS n, avg(flux) OVER p AS m, var_pop(flux) OVER p AS v, median(flux) OVER p AS med,
  {', '.join(f'lag(flux, {k}) OVER w AS l{k}' for k in ft.LAGS)}, row_number() OVER (PARTITION BY series_id ORDER BY flux, t, event_id) - 1 AS rk
  FROM es WINDOW w AS (PARTITION BY series_id ORDER BY t, event_id), p AS (PARTITION BY series_id)),
f1 AS (SELECT *, y - l1 AS dy, sqrt(n / (n - 1.0)) * (y - m) AS delta, sqrt(v) AS s FROM f0),
f2 AS (SELECT *, lead(delta) OVER w AS d2, lag(dy) OVER w AS dy0 FROM f1 WINDOW w AS (PARTITION BY series_id ORDER BY t, event_id)),
fa AS (SELECT series_id, first(n) AS n, first(m) AS m, first(v) AS v, first(med) AS med, avg(pow(y - m, 3)) AS m3, avg(pow(y - m, 4)) AS m4, median(abs(y - med)) AS mad,
  avg(CASE WHEN i % 2 = 0 AND d2 IS NOT NULL THEN sign(delta * d2) * sqrt(abs(delta * d2)) END) AS sj, avg(abs(y - m) / s) / sqrt(avg(pow((y - m) / s, 2)) + 1e-10) AS sk,
  avg(dy * dy) AS eta, avg(CASE WHEN dy0 IS NOT NULL THEN (sign(dy) = sign(dy0))::INTEGER END) AS rcs,
  quantile_cont(y, 0.05) AS q05, quantile_cont(y, 0.95) AS q95, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.9) AS q90, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.75) AS q75,
  max(y) - min(y) AS rg, avg((y > m + 2 * s)::INTEGER) AS ab, avg((y < m - 2 * s)::INTEGER) AS be, avg(CASE WHEN rk >= floor(0.05::DOUBLE * n) AND rk < n - floor(0.05::DOUBLE * n) THEN y END) AS tm,
  avg(CASE WHEN dy IS NOT NULL THEN (dy > 0)::INTEGER END) AS sl, {_acf} FROM f2 GROUP BY 1),
fs AS (SELECT series_id, rg AS phase_amplitude, m3 / pow(v, 1.5) AS phase_skewness, m AS flux_mean, sqrt(v) AS flux_std, m3 / pow(v, 1.5) AS flux_skewness, m4 / (v * v) - 3 AS flux_kurtosis, mad AS flux_mad,
  sj AS stetson_j, sk AS stetson_k, sj * sk / 0.798 AS stetson_l, eta / (2 * v + 1e-10) AS eta_index, rcs AS r_cs,
  (q95 - q05) / (abs(med) + 1e-10) AS f_5_95, (q90 - q10) / (abs(med) + 1e-10) AS f_10_90, (q75 - q25) / (abs(med) + 1e-10) AS f_25_75,
  {', '.join(f'a{k} / (v + 1e-20) AS acf_lag{k}' for k in ft.LAGS)}, m4 / (v * v) - 3 AS phase_kurtosis, sqrt(v) AS phase_std, rg AS flux_range, ab AS above_2sigma_frac, be AS below_2sigma_frac,
  med AS flux_median, tm AS flux_trimmed_mean, sl AS slope_ratio FROM fa)"""


#: Means of values with two decimals often end in exactly half a unit; engines then differ in the last bit and round apart.
NUDGE = 1e-9


def _shape(name: str, columns: tuple[str, ...]) -> None:
    def run(spark, d):
        x = ft.shape_features(src.events_series(spark, d))
        return x.select("series_id", *[r(F.col(c) + NUDGE, 5).alias(c) for c in columns])

    QUERIES[name] = (run, f"WITH {SHAPE} SELECT series_id, " + ", ".join(f"{q(f'{c} + {NUDGE}::DOUBLE', 5)} AS {c}" for c in columns) + " FROM fs")


_shape("feat_mad", ("flux_mad", "flux_median"))
_shape("feat_moments", ("flux_mean", "flux_std", "flux_skewness", "flux_kurtosis"))
_shape("feat_stetson", ("stetson_j", "stetson_k", "stetson_l"))
_shape("feat_eta", ("eta_index",))
_shape("feat_rcs", ("r_cs",))
_shape("feat_percentiles", ("f_5_95", "f_10_90", "f_25_75"))
_shape("feat_acf", tuple(f"acf_lag{k}" for k in ft.LAGS))
_shape("feat_outlier_frac", ("flux_range", "above_2sigma_frac", "below_2sigma_frac"))
_shape("feat_trimmed_slope", ("flux_trimmed_mean", "slope_ratio"))
_shape("feat_phase", ("phase_amplitude", "phase_skewness", "phase_kurtosis", "phase_std"))

FULL = SHAPE + "," + SECOND.split(o.ES + ",", 1)[1] + """,
fq AS (SELECT series_id, log10(pk.period + 1e-10) AS ls_period, pk.power AS ls_power, log10(pk.period + 1e-10) - log10(2 + 1e-10) AS period_ratio_half, log10(pk.period + 1e-10) + log10(2 + 1e-10) AS period_ratio_double,
  pk2.power AS ls_power_2nd, log10(pk2.period + 1e-10) AS ls_period_2nd FROM pk JOIN pk2 USING (series_id))"""


@query("features_35", f"WITH {FULL} SELECT series_id, " + ", ".join(f"{q(c, 4)} AS {c}" for c in FEATURES) + " FROM fs JOIN fq USING (series_id)")
def features_35(spark, d):
    return ft.features(src.events_series(spark, d)).select("series_id", *[r(c, 4).alias(c) for c in FEATURES])


DIST = ("flux_mean", "flux_std", "flux_range", "flux_median")
_pair = lambda src_, v: f"SELECT series_id, avg({v}) AS flux_mean, stddev_pop({v}) AS flux_std, max({v}) - min({v}) AS flux_range, median({v}) AS flux_median FROM {src_} GROUP BY 1"


@query("feature_distortion", f"""WITH {G3},{o.linear()}, a AS ({_pair('lin', 'imputed')}), b AS ({_pair('lin', 'truth')})
""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {q(f'avg(abs(a.{c} - b.{c}) / (abs(b.{c}) + 1e-8))')} AS distortion FROM a JOIN b USING (series_id)" for c in DIST))
def feature_distortion(spark, d):
    x = _linear30(spark, d).select("series_id", "t", "event_id", "imputed", "truth")
    a, b = (ft.shape_features(x, value=v).select("series_id", *DIST) for v in ("imputed", "truth"))
    return metrics.feature_distortion(a, b, DIST).withColumn("distortion", r("distortion"))
