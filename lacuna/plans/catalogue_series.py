"""Queries: sources, signals, gaps, preprocessing, window imputation, pointwise scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import gaps, impute, metrics, prep
from ..sources import series as src
from . import oracles as o
from .experiment import native_methods

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r(c, digits: int = 6) -> Column:
    """Rounded for comparison across engines, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def q(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


def gapped(spark: SparkSession, d: str) -> DataFrame:
    return gaps.hash_mask(src.events_series(spark, d))


def _filled(df: DataFrame) -> DataFrame:
    return df.where("is_missing").select("series_id", "fraction", "event_id", r("imputed").alias("imputed"))


FILLED = f"SELECT series_id, fraction, event_id, {q('imputed')} AS imputed"


@query("impute_linear_rmse", f"WITH {o.G},{o.linear()} SELECT fraction, count(*) AS n, {q('sqrt(avg(pow(imputed - truth, 2)))')} AS rmse, {q('avg(abs(imputed - truth))')} AS mae FROM lin WHERE is_missing GROUP BY fraction")
def impute_linear_rmse(spark, d):
    m = metrics.pointwise(impute.linear(gapped(spark, d)))
    return m.select("fraction", "n", r("rmse").alias("rmse"), r("mae").alias("mae"))


@query("scan_series", f"WITH {o.ES} SELECT series_id, event_id, {q('t')} AS t, flux FROM es")
def scan_series(spark, d):
    return src.events_series(spark, d).select("series_id", "event_id", r("t").alias("t"), "flux")


@query("scan_truncate_first", f"WITH {o.ES} SELECT series_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) AS rn FROM es) WHERE rn <= 40")
def scan_truncate_first(spark, d):
    return src.truncate_rows(src.events_series(spark, d), 40, ("series_id",), ("t", "event_id")).select("series_id", "event_id")


@query("completeness_gate", f"WITH {o.G} SELECT series_id, fraction, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(obs)::DOUBLE / count(*) >= 0.7")
def completeness_gate(spark, d):
    return src.completeness_gate(gapped(spark, d), 0.7, ("series_id", "fraction")).groupBy("series_id", "fraction").agg(F.count(F.lit(1)).alias("n"))


@query("catalogue_union_dedup", """WITH c AS (SELECT user_id AS KIC, 'EB' AS class_name, 0 AS p FROM events WHERE event_type = 'error'
  UNION ALL SELECT user_id, 'RRLYR', 1 FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 'ROT', 2 FROM events)
SELECT KIC, class_name, (CASE class_name WHEN 'EB' THEN 2 WHEN 'RRLYR' THEN 0 ELSE 5 END)::INTEGER AS class_label
FROM (SELECT *, row_number() OVER (PARTITION BY KIC ORDER BY p) AS rn FROM c) WHERE rn = 1""")
def catalogue_union_dedup(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("KIC"), "event_type")
    return src.union_catalogues([("EB", e.where("event_type = 'error'")), ("RRLYR", e.where("event_type = 'signup'")), ("ROT", e)])


@query("class_map_inner", """SELECT event_id, CASE event_type WHEN 'click' THEN 'DSCT' WHEN 'view' THEN 'GDOR' ELSE 'SOL' END AS class_name FROM events WHERE event_type IN ('click', 'view', 'error')""")
def class_map_inner(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return src.normalise_classes(e, "event_type", {"click": "DSCT", "view": "GDOR", "error": "SOL"}).select("event_id", "class_name")


def _signal(name: str, sql: str, **params):
    def run(spark, d):
        return src.events_series(spark, d).select("event_id", r(signal.signal(name, F.col("t"), A=0.1, P0=1.7, phi0=0.3, **params)).alias("flux"))

    QUERIES[f"signal_{name.split('_binary')[0]}" if name != "sinusoidal" else "signal_sinusoid"] = (run, f"WITH {o.ES} SELECT event_id, {q(sql)} AS flux FROM es")


_signal("sinusoidal", "1.0 + 0.1 * sin(2 * pi() * t / 1.7 + 0.3)")
_signal("multi_harmonic", "1.0 + 0.1 * sin(2 * pi() * t / 1.7 + 0.3) + 0.05 * sin(4 * pi() * t / 1.7 + 0.3) + 0.025 * sin(6 * pi() * t / 1.7 + 0.3)")
_signal("sawtooth", "1.0 + " + " + ".join(f"({(-1) ** (k + 1)} * 0.2 / (pi() * {k})) * sin({2 * k} * pi() * t / 1.7 + 0.3)" for k in range(1, 11)))


def _dip_sql(c: str, depth: str, dur: str) -> str:
    away = f"least(abs(ph - {c}), 1 - abs(ph - {c}))"
    return f"CASE WHEN {away} < 0.4 * {dur} THEN {depth} WHEN {away} < 0.5 * {dur} THEN {depth} * (0.5 * {dur} - {away}) / (0.1 * {dur}) ELSE 0 END"


_signal("eclipsing_binary", "x")
QUERIES["signal_eclipsing"] = (QUERIES["signal_eclipsing"][0], f"""WITH {o.ES}, p AS (SELECT *, t / 1.7 + 0.3 / (2 * pi()) - floor(t / 1.7 + 0.3 / (2 * pi())) AS ph FROM es)
SELECT event_id, {q(f"1.0 + 0.05 * cos(4 * pi() * t / 1.7) - ({_dip_sql('0.0', '0.08::DOUBLE', '0.15::DOUBLE')}) - ({_dip_sql('0.5', '0.03::DOUBLE', '0.105::DOUBLE')})")} AS flux FROM p""")


@query("phase_fold", f"WITH {o.ES} SELECT event_id, {q('(t - 2.5 * floor(t / 2.5)) / 2.5')} AS phase FROM es")
def phase_fold(spark, d):
    return src.events_series(spark, d).select("event_id", r(signal.phase_fold(F.col("t"), 2.5)).alias("phase"))


@query("gap_hash_mask", f"WITH {o.G} SELECT series_id, fraction, event_id, is_missing, obs FROM g")
def gap_hash_mask(spark, d):
    return gapped(spark, d).select("series_id", "fraction", "event_id", "is_missing", "obs")


@query("gap_hash_block_mask", f"""WITH {o.ES}, b AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) - 1) // 5 AS blk FROM es)
SELECT event_id, ((blk * 7919 + series_id) * 2654435761) % 1000 < 300 AS is_missing FROM b""")
def gap_hash_block_mask(spark, d):
    return gaps.hash_mask(src.events_series(spark, d), (0.3,), block=5).select("event_id", "is_missing")


@query("gap_apply_mask", """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS obs FROM orders""")
def gap_apply_mask(spark, d):
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("flux"))
    mask = x.select("idx", (F.pmod(F.col("idx"), F.lit(3)) != 0).cast("int").alias("mask"))
    return gaps.apply_mask(x, mask).select("idx", "obs")


RUNS = o.G + f""",
n AS (SELECT *, row_number() OVER ({o.W}) - 1 AS i FROM g), k AS (SELECT *, i - row_number() OVER ({o.W}) AS k FROM n WHERE is_missing),
runs AS (SELECT series_id, fraction, min(i) AS start, count(*) AS length FROM k GROUP BY series_id, fraction, k)"""


@query("gap_runs", f"WITH {RUNS} SELECT series_id, fraction, start, length FROM runs")
def gap_runs(spark, d):
    return gaps.gap_runs(gapped(spark, d))


@query("gap_stats", f"WITH {RUNS} SELECT fraction, count(*) AS n_gaps, min(length) AS min_length, max(length) AS max_length, {q('avg(length)')} AS mean_length, quantile_cont(length, 0.5)::DOUBLE AS median_length, {q('stddev_pop(length)')} AS std_length FROM runs GROUP BY fraction")
def gap_stats(spark, d):
    s = gaps.gap_stats(gaps.gap_runs(gapped(spark, d)))
    return s.withColumn("mean_length", r("mean_length")).withColumn("std_length", r("std_length"))


@query("missing_summary", f"WITH {o.G} SELECT fraction, count(*) AS total, count(obs) AS observed, count(*) - count(obs) AS missing, {q('100e0 * (count(*) - count(obs)) / count(*)')} AS pct_missing FROM g GROUP BY fraction")
def missing_summary(spark, d):
    return gaps.missing_summary(gapped(spark, d)).withColumn("pct_missing", r("pct_missing"))


@query("null_counts", f"WITH {o.G} SELECT 'obs' AS \"column\", count(*) - count(obs) AS n_null FROM g UNION ALL SELECT 'truth', count(*) - count(truth) FROM g")
def null_counts(spark, d):
    return gaps.null_counts(gapped(spark, d), ["obs", "truth"])


@query("missing_positions", f"WITH {o.G} SELECT series_id, fraction, i AS idx FROM (SELECT *, row_number() OVER ({o.W}) - 1 AS i FROM g) WHERE is_missing")
def missing_positions(spark, d):
    return gaps.missing_positions(gapped(spark, d))


OD = """od AS (SELECT o_orderpriority AS series, floor(epoch_us(o_orderdate)::DOUBLE / 86400e6) AS t, sum(o_totalprice) AS flux FROM orders GROUP BY 1, 2)"""
SEG = OD + """,
s1 AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS dt FROM od),
s2 AS (SELECT *, median(dt) OVER (PARTITION BY series) AS md FROM s1),
seg AS (SELECT series, t, flux, (sum(CASE WHEN dt > 2 * md THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t))::INTEGER AS segment FROM s2)"""
OFF = SEG + """,
off AS (SELECT series, t, segment, flux - median(flux) OVER (PARTITION BY series, segment) + median(flux) OVER (PARTITION BY series) AS flux FROM seg)"""


def rolled(source: str) -> str:
    return f"""
rl AS (SELECT *, quantile_cont(flux, 0.5) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS rolling FROM {source}),
rs AS (SELECT *, flux - rolling AS res FROM rl), rm AS (SELECT *, median(res) OVER (PARTITION BY series) AS mid FROM rs),
rd AS (SELECT *, median(abs(res - mid)) OVER (PARTITION BY series) AS mad FROM rm),
clip AS (SELECT * FROM rd WHERE mad = 0 OR abs(res) <= 3.0 * mad / 0.6745)"""


@query("segment_sessionize", f"WITH {SEG} SELECT series, t, segment FROM seg")
def segment_sessionize(spark, d):
    return prep.segments(src.orders_daily(spark, d), 2.0).select("series", "t", "segment")


@query("quarter_offset", f"WITH {OFF} SELECT series, t, {q('flux', 4)} AS flux FROM off")
def quarter_offset(spark, d):
    return prep.offset_correct(prep.segments(src.orders_daily(spark, d), 2.0)).select("series", "t", r("flux", 4).alias("flux"))


@query("rolling_median", f"WITH {OD},{rolled('od')} SELECT series, t, {q('rolling', 4)} AS rolling FROM rl")
def rolling_median(spark, d):
    return prep.rolling_median(src.orders_daily(spark, d)).select("series", "t", r("rolling", 4).alias("rolling"))


@query("sigma_clip", f"WITH {OD},{rolled('od')} SELECT series, t, {q('flux', 4)} AS flux FROM clip")
def sigma_clip(spark, d):
    return prep.sigma_clip(src.orders_daily(spark, d), 3.0).select("series", "t", r("flux", 4).alias("flux"))


@query("quality_filter", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def quality_filter(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.pmod(F.col("event_id"), F.lit(7)).alias("quality"))
    return prep.quality_filter(e, "quality").select("event_id")


@query("median_normalize", f"WITH {OD} SELECT series, t, {q('flux / median(flux) OVER (PARTITION BY series)')} AS flux FROM od")
def median_normalize(spark, d):
    return prep.median_normalise(src.orders_daily(spark, d)).select("series", "t", r("flux").alias("flux"))


@query("preprocess_full", f"WITH {OFF.replace('2 * md', '10 * md')},{rolled('off')} SELECT series, t, {q('flux / median(flux) OVER (PARTITION BY series)')} AS flux FROM clip")
def preprocess_full(spark, d):
    return prep.preprocess(src.orders_daily(spark, d), 3.0).select("series", "t", r("flux").alias("flux"))


GN = o.G + f""",
gn AS (SELECT *, row_number() OVER ({o.W}) - 1 AS i, count(*) OVER (PARTITION BY series_id, fraction) AS n FROM g)"""


@query("truncate_middle", f"WITH {GN} SELECT fraction, event_id FROM gn WHERE n <= 40 OR (i >= floor((n - 40) / 2.0) AND i < floor((n - 40) / 2.0) + 40)")
def truncate_middle(spark, d):
    return prep.truncate(gapped(spark, d), 40, "middle", keys=impute.KEYS, order=impute.ORDER).select("fraction", "event_id")


@query("truncate_densest", f"""WITH {GN}, c AS (SELECT *, count(obs) OVER ({o.W} ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS c FROM gn),
s AS (SELECT series_id, fraction, i AS st FROM (SELECT *, row_number() OVER (PARTITION BY series_id, fraction ORDER BY c DESC, i) AS rn FROM c WHERE i <= n - 40) WHERE rn = 1)
SELECT gn.fraction, gn.event_id FROM gn LEFT JOIN s USING (series_id, fraction) WHERE n <= 40 OR (i >= st AND i < st + 40)""")
def truncate_densest(spark, d):
    return prep.truncate(gapped(spark, d), 40, "densest", keys=impute.KEYS, order=impute.ORDER).select("fraction", "event_id")


HASHED = "(event_id * 2654435761) % 1000003, event_id"


@query("sample_per_class", f"SELECT event_type AS label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {HASHED}) AS rn FROM events) WHERE rn <= 100")
def sample_per_class(spark, d):
    return prep.sample_per_class(src.events_series(spark, d).select("label", "event_id"), 100)


@query("stratified_split", f"SELECT event_type AS label, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {HASHED}) <= floor(count(*) OVER (PARTITION BY event_type) * 0.3::DOUBLE) AS is_test FROM events")
def stratified_split(spark, d):
    return prep.stratified_split(src.events_series(spark, d).select("label", "event_id"))


@query("class_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def class_counts(spark, d):
    return prep.class_counts(src.events_series(spark, d))


@query("impute_mean", f"WITH {o.G} {FILLED} FROM (SELECT *, {o.MEAN} AS imputed FROM g) WHERE is_missing")
def impute_mean(spark, d):
    return _filled(impute.mean_fill(gapped(spark, d)))


@query("impute_ffill", f"WITH {o.G} {FILLED} FROM (SELECT *, {o.FFILL} AS imputed FROM g) WHERE is_missing")
def impute_ffill(spark, d):
    return _filled(impute.forward_fill(gapped(spark, d)))


@query("impute_ffill_only", f"WITH {o.G} {FILLED} FROM (SELECT *, last_value(obs IGNORE NULLS) OVER ({o.W} {o.UP}) AS imputed FROM g) WHERE is_missing")
def impute_ffill_only(spark, d):
    return _filled(impute.forward_fill(gapped(spark, d), backfill=False))


@query("impute_linear", f"WITH {o.G},{o.linear()} {FILLED} FROM lin WHERE is_missing")
def impute_linear(spark, d):
    return _filled(impute.linear(gapped(spark, d)))


@query("impute_linear_clamp", f"WITH {o.G},{o.linear('clamp')} {FILLED} FROM lin WHERE is_missing")
def impute_linear_clamp(spark, d):
    return _filled(impute.linear(gapped(spark, d), ends="clamp"))


@query("impute_linear_index", f"WITH {o.G},{o.linear('clamp', f'(row_number() OVER ({o.W}))::DOUBLE')} {FILLED} FROM lin WHERE is_missing")
def impute_linear_index(spark, d):
    return _filled(impute.linear(gapped(spark, d), ends="clamp", by="index"))


def _knn_sql(W: int, where: str) -> str:
    slots = ", ".join(f"{'lag' if j < W else 'lead'}(obs, {abs(W - j)}) OVER ({o.W}) AS d{j}" for j in range(2 * W))
    dist = " + ".join(f"coalesce(pow(a.d{j} - b.d{j}, 2), 0)" for j in range(2 * W))
    return f"""WITH {o.G}, s AS (SELECT *, row_number() OVER ({o.W}) AS i, {slots}, count(obs) OVER ({o.W} ROWS BETWEEN {W} PRECEDING AND {W - 1} FOLLOWING) AS c,
    avg(obs) OVER (PARTITION BY series_id, fraction) AS mu FROM g WHERE {where}),
n AS (SELECT a.series_id, a.fraction, a.event_id, b.i AS bi, b.obs AS f, sqrt({dist}) AS dist FROM s a JOIN s b ON a.series_id = b.series_id AND a.fraction = b.fraction
  WHERE a.obs IS NULL AND a.c > 0 AND b.c = {2 * W} AND b.obs IS NOT NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, fraction, event_id ORDER BY dist, bi) AS rn FROM n) WHERE rn <= 5),
e AS (SELECT series_id, fraction, event_id, sum(f / (dist + 1e-8)) / sum(1 / (dist + 1e-8)) AS est FROM k GROUP BY ALL)
SELECT s.series_id, s.fraction, s.event_id, {q('coalesce(est, mu)')} AS imputed FROM s LEFT JOIN e USING (series_id, fraction, event_id) WHERE is_missing"""


@query("impute_knn", _knn_sql(4, "fraction < 0.4"))
def impute_knn(spark, d):
    return _filled(impute.knn(gaps.hash_mask(src.events_series(spark, d), (0.1, 0.3)), W=4))


@query("impute_knn_index", _knn_sql(10, "true"))
def impute_knn_index(spark, d):
    """The default neighbourhood and all fractions, through the block index."""
    return _filled(impute.knn(gapped(spark, d), index=True))


_lagcols = ", ".join(f"{q(f'{f}(obs, {k}) OVER ({o.W})')} AS {f}{k}" for k in range(1, 6) for f in ("lag", "lead"))


@query("lag_phase_matrix", f"WITH {o.G} SELECT series_id, fraction, event_id, {q('obs')} AS lag0, {_lagcols}, {q('sin(2 * pi() * t / 2.5)')} AS \"sin\", {q('cos(2 * pi() * t / 2.5)')} AS \"cos\" FROM g")
def lag_phase_matrix(spark, d):
    x = impute.lag_phase_matrix(gapped(spark, d), period=2.5)
    names = ["lag0", *[f"{f}{k}" for k in range(1, 6) for f in ("lag", "lead")], "sin", "cos"]
    return x.select("series_id", "fraction", "event_id", *[r(c).alias(c) for c in names])


HANKEL = o.ES + """,
hi AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM es),
hk AS (SELECT a.series_id, j, a.i - j AS k, a.flux AS value FROM hi a, unnest(range(0, a.n // 2)) AS u(j) WHERE a.i - j >= 0 AND a.i - j <= a.n - a.n // 2)"""


@query("hankel_embed", f"WITH {HANKEL} SELECT series_id, j, k, value FROM hk")
def hankel_embed(spark, d):
    return impute.hankel_embed(src.events_series(spark, d))


@query("hankel_deembed", f"WITH {HANKEL} SELECT series_id, j + k AS idx, {q('avg(value)')} AS value FROM hk GROUP BY 1, 2")
def hankel_deembed(spark, d):
    return impute.hankel_deembed(impute.hankel_embed(src.events_series(spark, d))).withColumn("value", r("value"))


@query("metric_pointwise", f"WITH {o.IMPS} SELECT method, fraction, count(*) AS n, {q('sqrt(avg(pow(imputed - truth, 2)))')} AS rmse, {q('avg(abs(imputed - truth))')} AS mae, {q('avg(pow(imputed - truth, 2))')} AS mse, {q('avg(abs(imputed - truth) / (abs(truth) + 1e-8))')} AS relative_error FROM im WHERE is_missing GROUP BY ALL")
def metric_pointwise(spark, d):
    m = metrics.pointwise(native_methods(gapped(spark, d)), ("method", "fraction"))
    return m.select("method", "fraction", "n", *[r(c).alias(c) for c in ("rmse", "mae", "mse", "relative_error")])


@query("metric_r2", f"WITH {o.IMPS} SELECT method, fraction, {q('1 - sum(pow(imputed - truth, 2)) / (var_pop(truth) * count(*))')} AS r2 FROM im WHERE is_missing GROUP BY ALL")
def metric_r2(spark, d):
    return metrics.r2(native_methods(gapped(spark, d)), ("method", "fraction")).withColumn("r2", r("r2"))


@query("metric_amplitude", f"WITH {o.G},{o.linear()} SELECT series_id, fraction, {q('abs((max(imputed) - min(imputed)) / 2 - 20.0) / (20.0 + 1e-8)')} AS amplitude_error FROM lin GROUP BY 1, 2")
def metric_amplitude(spark, d):
    return metrics.amplitude_error(impute.linear(gapped(spark, d)), 20.0).withColumn("amplitude_error", r("amplitude_error"))


@query("corr_orig_corrupt", f"WITH {o.IMPS} SELECT method, fraction, {q('corr(truth, imputed)')} AS corr FROM im GROUP BY ALL")
def corr_orig_corrupt(spark, d):
    return metrics.correlation(native_methods(gapped(spark, d)), "truth", "imputed", ("method", "fraction")).withColumn("corr", r("corr"))


@query("flux_summary", f"WITH {o.G} SELECT fraction, count(obs) AS n, {q('avg(obs)')} AS mean, {q('median(obs)')} AS median, {q('stddev_samp(obs)')} AS std, min(obs) AS min, max(obs) AS max FROM g GROUP BY 1")
def flux_summary(spark, d):
    s = metrics.describe(gapped(spark, d), "obs", ("fraction",))
    return s.select("fraction", "n", *[r(c).alias(c) for c in ("mean", "median", "std")], "min", "max")


@query("histogram", f"WITH {o.ES} SELECT label, least(floor((flux - 0) / 5.0), 19)::INTEGER AS bin, count(*) AS n FROM es WHERE flux BETWEEN 0 AND 100 GROUP BY 1, 2")
def histogram(spark, d):
    return metrics.histogram(src.events_series(spark, d), "flux", 0.0, 100.0, 20, ("label",))
