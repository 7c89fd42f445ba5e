"""Rank tests, effect sizes and bootstrap intervals over result tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .order import joined, ranked_values


def paired(raw: DataFrame, metric: str, baseline: str, by: Sequence[str] = ("fraction",), seed: str = "seed") -> DataFrame:
    """``(*by, method, seed, x, y)``: each method's value y beside the baseline's x, joined on the seed."""
    base = raw.where(F.col("method") == baseline).select(*by, seed, F.col(metric).alias("x"))
    return raw.where(F.col("method") != baseline).select(*by, "method", seed, F.col(metric).alias("y")).join(base, [*by, seed])


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ("fraction", "method"), alternative: str = "two-sided", with_p: bool = False) -> DataFrame:
    """Signed-rank sums of x - y: ``(*by, n, w_plus, w_minus, statistic, tie_term)``, zero differences dropped.

    Ranks of ties are averaged; differences are ranked by their distinct sizes, so no task holds a group. ``with_p`` adds the p-value, computed for each group's row in an Arrow batch.
    """
    d = pairs.withColumn("d", F.col("x") - F.col("y")).where("d <> 0").withColumn("_a", F.round(F.abs("d"), 12))
    signs = {"pos": F.count_if(F.col("d") > 0), "neg": F.count_if(F.col("d") < 0)}
    r = ranked_values(d, by, ["_a"], signs).withColumn("_r", F.col("rank") + (F.col("ties") - 1) / 2.0)
    s = r.groupBy(*by).agg(
        F.sum("ties").alias("n"), F.sum(F.col("pos") * F.col("_r")).alias("w_plus"), F.sum(F.col("neg") * F.col("_r")).alias("w_minus"),
        F.sum((F.col("ties") * (F.col("ties") * F.col("ties") - 1)).cast("double")).alias("tie_term"))
    stat = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    s = s.withColumn("statistic", stat)
    if not with_p:
        return s

    @F.pandas_udf("double")
    def p_value(w_plus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([special.wilcoxon_p(a, int(b), c, alternative) for a, b, c in zip(w_plus, n, ties)])

    return s.withColumn("p_value", p_value("w_plus", "n", "tie_term"))


def mean_ranks(raw: DataFrame, metric: str, by: Sequence[str] = ("fraction",), block: str = "seed") -> DataFrame:
    """``(*by, method, mean_rank, rank_sum, n_blocks, k)``: ranks of the methods within each block, ties averaged."""
    w = Window.partitionBy(*by, block)
    x = raw.withColumn("_v", F.round(metric, 12))
    r = x.withColumn("_r", F.rank().over(w.orderBy("_v")) + (F.count(F.lit(1)).over(Window.partitionBy(*by, block, "_v")) - 1) / 2.0)
    return r.withColumn("_k", F.count(F.lit(1)).over(w)).groupBy(*by, "method").agg(F.avg("_r").alias("mean_rank"), F.sum("_r").alias("rank_sum"), F.count(F.lit(1)).alias("n_blocks"), F.max("_k").alias("k"))


def friedman(raw: DataFrame, metric: str, by: Sequence[str] = ("fraction",), block: str = "seed", with_p: bool = False) -> DataFrame:
    """``(*by, n, k, statistic)`` with tie correction; NULL where every block is tied."""
    x = raw.withColumn("_v", F.round(metric, 12))
    ties = x.groupBy(*by, block, "_v").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.expr("cast(t * t * t - t as double)")).alias("ties"))
    ranks = mean_ranks(raw, metric, by, block).groupBy(*by).agg(F.max("n_blocks").alias("n"), F.max("k").alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("r2"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    corr = 1 - F.col("ties") / (n * k * (k * k - 1))
    stat = (12 / (n * k * (k + 1)) * F.col("r2") - 3 * n * (k + 1)) / F.when(F.abs(corr) > 1e-12, corr)
    out = ranks.join(ties, list(by)).select(*by, "n", "k", stat.alias("statistic"))
    if not with_p:
        return out

    @F.pandas_udf("double")
    def p_value(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else special.chi2_sf(a, int(b) - 1) for a, b in zip(s, k)], dtype="float64")

    return out.withColumn("p_value", p_value("statistic", "k"))


def nemenyi(raw: DataFrame, metric: str, by: Sequence[str] = ("fraction",), block: str = "seed", with_p: bool = True) -> DataFrame:
    """``(*by, a, b, q, p_value)`` for every pair of methods, from their mean ranks."""
    r = mean_ranks(raw, metric, by, block)
    a = r.select(*by, F.col("method").alias("a"), F.col("mean_rank").alias("ra"), "n_blocks", "k")
    b = r.select(*by, F.col("method").alias("b"), F.col("mean_rank").alias("rb"))
    q = F.abs(F.col("ra") - F.col("rb")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n_blocks")))
    out = a.join(b, list(by)).where("a <> b").select(*by, "a", "b", "k", q.alias("q"))
    if not with_p:
        return out

    @F.pandas_udf("double")
    def p_value(q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([special.studentized_range_sf(x * np.sqrt(2), int(g)) for x, g in zip(q, k)])

    return out.withColumn("p_value", p_value("q", "k"))


def cohens_d(pairs: DataFrame, by: Sequence[str] = ("fraction", "method")) -> DataFrame:
    pooled = F.sqrt(((F.count("x") - 1) * F.var_samp("x") + (F.count("y") - 1) * F.var_samp("y")) / F.nullif(F.count("x") + F.count("y") - 2, F.lit(0)))
    return pairs.groupBy(*by).agg(((F.avg("x") - F.avg("y")) / (pooled + 1e-10)).alias("cohens_d"))


def rank_biserial(tests: DataFrame) -> DataFrame:
    """Adds the matched-pairs rank-biserial effect size to Wilcoxon sums."""
    return tests.withColumn("effect_size", (F.col("w_plus") - F.col("w_minus")) / F.nullif(F.col("w_plus") + F.col("w_minus"), F.lit(0.0)))


def bootstrap_ci(df: DataFrame, value: str, by: Sequence[str] = ("method", "fraction"), n_bootstrap: int = 10_000, ci: float = 0.95, seed: int = 42, stat: Callable[..., np.ndarray] = np.mean) -> DataFrame:
    """``(*by, ci_lower, ci_upper)``: percentile intervals; ``stat`` takes ``axis=1``. Resamples run in blocks of bounded memory."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", ci_lower double, ci_upper double"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[value].dropna().to_numpy(dtype=float)
        rng, stats = np.random.default_rng(seed), []
        step = max(1, 2_000_000 // max(1, len(x)))
        for at in range(0, n_bootstrap if len(x) else 0, step):
            stats.append(stat(x[rng.integers(0, len(x), (min(step, n_bootstrap - at), len(x)))], axis=1))
        lo, hi = np.quantile(np.concatenate(stats), [(1 - ci) / 2, (1 + ci) / 2]) if stats else (None, None)
        return pd.DataFrame([[*key, lo, hi]], columns=[*by, "ci_lower", "ci_upper"])

    return df.select(*by, value).groupBy(*by).applyInPandas(run, schema)


#: A prime, and the bounds below which a number under it counts as 0, 1, 2, ... of a Poisson distribution with mean 1.
PRIME = (1 << 31) - 1
POISSON = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10))


def poisson_weight(row: Column, resample: Column, seed: int = 42) -> Column:
    """How often a row occurs in a resample: Poisson with mean 1, by a hash in whole numbers under 2^62 that any SQL engine repeats."""
    p = F.lit(PRIME).cast("long")
    a = (F.pmod(row.cast("long"), p) * 48271 + resample.cast("long") * 69621 + seed) % p
    b = (a * a + 12345) % p
    c = (b * 16807 + a) % p
    d = (c * c + resample) % p
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(d < POISSON[k], F.lit(k)).otherwise(out)
    return out


def poisson_bootstrap(df: DataFrame, value: str, by: Sequence[str] = ("method", "fraction"), id_col: str = "seed", n_bootstrap: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """``(*by, n, mean, ci_lower, ci_upper)``: percentile interval of the mean over resamples in which each row has a Poisson weight (Chamandy et al. 2012).

    A row meets its resamples in its own task and only sums of weights are shuffled, combined map-side, so no group is gathered; the quantiles see ``n_bootstrap`` numbers a
    group. Weights depend on (id, resample, seed) alone: rows of one id in a group are drawn together, null ids count as one. Null values don't count; a group without values has no row.
    """
    kind = dict(df.dtypes)[id_col]
    row = F.coalesce(F.col(id_col) if kind in ("bigint", "int", "smallint", "tinyint") else F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0))
    rows = df.where(F.col(value).isNotNull()).select(*by, row.alias("_id"), F.col(value).cast("double").alias("_v"))
    each = rows.select(*by, "_id", "_v", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("_b")).withColumn("_w", poisson_weight(F.col("_id"), F.col("_b"), seed))
    sums = each.where("_w > 0").groupBy(*by, "_b").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
    q = F.percentile(F.col("_s") / F.col("_n"), F.array(F.lit((1 - ci) / 2), F.lit((1 + ci) / 2)))
    bounds = sums.groupBy(*by).agg(q.alias("_q"))
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return joined(plain, bounds, by).select(*by, "n", "mean", F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))


def stats_table(raw: DataFrame, metric: str = "rmse", fraction: float = 0.3, baseline: str = "Linear-Interp", n_bootstrap: int = 10_000, seed: int = 42, with_ci: bool = True) -> DataFrame:
    """Per method: mean, deviation, interval, and the tests against the baseline (NULL for itself), by mean."""
    sub = raw.where(F.abs(F.col("fraction") - fraction) < 1e-9)
    base = sub.groupBy("method").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    pairs = paired(sub, metric, baseline, by=())
    tests = wilcoxon(pairs, ("method",), with_p=with_ci).withColumnRenamed("statistic", "wilcoxon_stat")
    tests = tests.withColumnRenamed("p_value", "wilcoxon_p").select("method", "wilcoxon_stat", *(["wilcoxon_p"] if with_ci else []))
    d = cohens_d(pairs, ("method",))
    out = base.join(tests, "method", "left").join(d, "method", "left").withColumn("cohens_d", F.when(F.col("method") == baseline, F.lit(0.0)).otherwise(F.col("cohens_d")))
    if with_ci:
        out = out.join(poisson_bootstrap(sub, metric, ("method",), n_bootstrap=n_bootstrap, seed=seed).select("method", "ci_lower", "ci_upper"), "method")
    return out.orderBy("mean")


def decision_table(raw: DataFrame, metric: str, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """Per fraction: Friedman over all methods, Wilcoxon of two of them, effect size, and the decisions."""
    fr = friedman(raw, metric, with_p=True).select("fraction", F.col("statistic").alias("friedman"), F.col("p_value").alias("friedman_p"))
    pairs = paired(raw.where(F.col("method").isin(first, second)), metric, first)
    wx = rank_biserial(wilcoxon(pairs, ("fraction",), with_p=True)).select("fraction", F.col("statistic").alias("wilcoxon"), F.col("p_value").alias("wilcoxon_p"), "effect_size")
    return fr.join(wx, "fraction", "left").withColumns({"reject": F.col("friedman_p") < alpha, "significant": F.col("wilcoxon_p") < alpha})
