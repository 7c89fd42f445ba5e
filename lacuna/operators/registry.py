"""The thirteen imputers by key: window plans and grouped kernels behind one call."""

from __future__ import annotations

import math
import resource
import time
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import impute as native
from . import kernels
from .batches import in_series, numbers, put, whole_series
from .gaps import key_seed


@dataclass(frozen=True)
class Method:
    """``plan`` is a DataFrame -> DataFrame function; ``kernel`` fills one series, ``many`` a list of them in one call. Parameters not in ``params`` are dropped."""

    key: str
    name: str
    plan: Callable | None = None
    kernel: Callable | None = None
    params: frozenset[str] = field(default_factory=frozenset)
    many: Callable | None = None


def _m(key: str, name: str, plan=None, kernel=None, params: str = "", many=None) -> Method:
    return Method(key, name, plan, kernel, frozenset(params.split()), many)


_METHODS = [
    _m("mean_fill", "Mean-Fill", plan=lambda df, keys, order, **p: native.mean_fill(df, keys)),
    _m("forward_fill", "Forward-Fill", plan=lambda df, keys, order, **p: native.forward_fill(df, keys=keys, order=order, **p), params="backfill"),
    _m("linear_interp", "Linear-Interp", plan=lambda df, keys, order, **p: native.linear(df, keys=keys, order=order, **p), params="ends by"),
    _m("spline_interp", "Spline-Interp", kernel=kernels.spline),
    _m("gp_matern", "GP-Matern32", kernel=kernels.gp_matern, params="restarts"),
    _m("ts_mice", "TS-MICE", kernel=kernels.ts_mice, params="L max_iter n_chains"),
    _m("knn_impute", "KNN-Impute", plan=lambda df, keys, order, **p: native.knn(df, keys=keys, order=order, **p), params="k W"),
    _m("rf_impute", "RF-Impute", kernel=kernels.rf_impute, params="L n_estimators max_depth"),
    _m("rnn_impute", "RNN-Impute", kernel=kernels.rnn_impute, params="hidden_size epochs lr", many=kernels.rnn_many),
    _m("gain_impute", "GAIN-Impute", kernel=kernels.gain_impute, params="hint_rate lambda_recon epochs lr"),
    _m("mf_impute", "MF-Impute", kernel=kernels.mf_impute, params="rank alpha tol max_iter"),
    _m("gb_mice", "GB-MICE", kernel=kernels.gb_mice, params="L n_estimators max_depth max_iter n_chains learning_rate", many=kernels.gb_many),
    _m("saits", "SAITS", kernel=kernels.saits, params="d_model n_heads n_layers epochs lr diagonal_mask"),
]
REGISTRY: dict[str, Method] = {m.key: m for m in _METHODS}
#: Parameter names that configurations may use.
ALIASES = {"n_restarts": "restarts"}


def list_imputers() -> list[str]:
    return sorted(REGISTRY)


def register(method: Method) -> None:
    """Adds an imputer of one's own, as a plan or a kernel."""
    REGISTRY[method.key] = method


def get_imputer(key: str) -> Method:
    if key not in REGISTRY:
        raise KeyError(f"unknown imputer {key!r}; known: {', '.join(list_imputers())}")
    return REGISTRY[key]


FAILURES = (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError)


def _fill(method: Method, series: list, options: Mapping) -> tuple[list, list[float]]:
    """Each series filled, None where the kernel failed, and its seconds; those of a common call are shared by rows."""
    out: list = [y.copy() for _, y, *_ in series]
    seconds = [0.0] * len(series)
    todo = [i for i, s in enumerate(series) if s[2].any()]
    if method.many:
        some = [i for i in todo if not series[i][2].all()]  # nothing to learn from otherwise: left to the kernel
        start = time.perf_counter()
        try:
            for i, filled in zip(some, method.many([series[i] for i in some], **options)):
                out[i] = filled
            rows = sum(len(series[i][1]) for i in some)
            for i in some:
                seconds[i] = (time.perf_counter() - start) * len(series[i][1]) / rows
            todo = [i for i in todo if series[i][2].all()]
        except FAILURES:  # one by one tells which
            fresh = [np.random.default_rng(rng.bit_generator.seed_seq) for *_, rng in series]
            series = [(*s[:4], rng) for s, rng in zip(series, fresh)]
    for i in todo:
        start = time.perf_counter()
        try:
            out[i] = method.kernel(*series[i], **options)
        except FAILURES:
            out[i] = None
        seconds[i] = time.perf_counter() - start
    return out, seconds


def _kernel_run(method: Method, keys: Sequence[str], order: Sequence[str], options: Mapping):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends, names in whole_series(batches, keys):
            t, y = numbers(table[order[0]]), numbers(table["obs"])
            period = numbers(table["period"]) if "period" in table.column_names else np.ones(len(y))
            spans = list(zip(ends[:-1], ends[1:]))
            series = [(t[a:b], y[a:b], np.isnan(y[a:b]), float(period[a]), np.random.default_rng([key_seed(k) for k in name])) for (a, b), name in zip(spans, names)]
            filled, seconds = _fill(method, series, options)
            imputed, failed = np.empty(len(y)), np.zeros(len(y), dtype=bool)
            for (a, b), (_, obs, gone, *_), out in zip(spans, series, filled):
                if out is None or not np.isfinite(out).all():
                    if gone.any():
                        failed[a:b] = True
                        out = np.where(gone, obs[~gone].mean() if (~gone).any() else np.nan, obs)
                imputed[a:b] = out
            sizes = np.diff(ends)
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            for name, values in (("imputed", pa.array(imputed, from_pandas=True)), ("failed", pa.array(failed)), ("runtime_s", pa.array(np.repeat(seconds, sizes))), ("memory_mb", pa.array(np.full(len(y), peak)))):
                table = put(table, name, values)
            yield from table.to_batches(max_chunksize=10_000)

    return run


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The exchange a grouped kernel needs, with a fixed number of partitions: kernels cost far more than their bytes
    suggest, so small partitions must not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def impute(df: DataFrame, key: str, params: Mapping | None = None, keys: Sequence[str] = native.KEYS, order: Sequence[str] = native.ORDER) -> DataFrame:
    """``df`` plus ``method_key, method, imputed, failed, runtime_s, memory_mb``; observed values stay as they are.

    A task takes its series in batches; methods with ``many`` train a batch's models side by side and share its time by rows. A kernel that fails on a series fills it
    with its mean and says so in ``failed``. Window methods share a plan with all series, so their
    run time and memory are NULL. ``memory_mb`` is the peak resident memory of the Python worker up to the end of the series, so it never falls
    within a worker. Kernels use a ``period`` column if there is one (1.0 otherwise). Parameters that the method doesn't have are dropped with a warning.
    """
    method = get_imputer(key)
    given = {ALIASES.get(k, k): v for k, v in (params or {}).items()}
    options = {k: v for k, v in given.items() if k in method.params}
    if len(options) < len(given):
        warnings.warn(f"{method.key} takes no {', '.join(sorted(given.keys() - options.keys()))}", stacklevel=2)
    tag = {"method_key": F.lit(method.key), "method": F.lit(method.name)}
    if method.plan:
        out = method.plan(df, keys, order, **options)
        return out.withColumns(tag | {"failed": F.lit(False), "runtime_s": F.lit(None).cast("double"), "memory_mb": F.lit(None).cast("double")})
    schema = df.withColumns({"imputed": F.lit(0.0), "failed": F.lit(False), "runtime_s": F.lit(0.0), "memory_mb": F.lit(0.0)}).schema
    return in_series(df, keys, order).mapInArrow(_kernel_run(method, keys, order, options), schema).withColumns(tag)


def gp_with_variance(df: DataFrame, restarts: int = 20, keys: Sequence[str] = native.KEYS, order: Sequence[str] = native.ORDER) -> DataFrame:
    """Gaussian-process imputation with the posterior ``variance`` of every missing sample (0 where observed)."""
    schema = df.withColumns({"imputed": F.lit(0.0), "variance": F.lit(0.0)}).schema
    sort = list(order)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(sort, ignore_index=True)
        t, y = frame[sort[0]].to_numpy(dtype=float), frame["obs"].to_numpy(dtype=float)
        gone = np.isnan(y)
        out, var = y.copy(), np.zeros(len(y))
        if gone.any() and (~gone).sum() > 1:
            out[gone], var[gone] = kernels.gp_predict(t, y, gone, np.random.default_rng(0), restarts)
        elif (~gone).any():
            out[gone] = np.nanmean(y)
        frame["imputed"], frame["variance"] = out, var
        return frame

    return _dealt(df, keys).groupBy(*keys).applyInPandas(run, schema)


def _ranges(h: DataFrame, buckets: int = 4096) -> DataFrame:
    """``(series_id, start)``: where each series' numbers begin. Sums within hash buckets of series, then over the buckets:
    the one-task window sees a row a bucket, and so does the broadcast."""
    sizes = h.groupBy("series_id").agg((F.greatest(F.max("j"), F.max("k")) + 1).cast("long").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)))
    ahead = lambda w: F.sum("n").over(w) - F.col("n")
    before = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", ahead(Window.orderBy("bucket")).alias("before"))
    within = sizes.select("series_id", "bucket", ahead(Window.partitionBy("bucket").orderBy("series_id")).alias("within"))
    return within.join(F.broadcast(before), "bucket").select("series_id", (F.col("before") + F.col("within")).alias("start"))


#: Cells of an ALS block, about; the most blocks (each task has a buffer a pair of them); numbers of a series that still has one block.
CELLS, BLOCKS, LONG = 1 << 21, 1000, 1 << 10


def _numbered(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """The cells of all series with their ALS numbers ``u`` and ``v``, and the number of blocks, which grows with the cells.

    ALS deals numbers to blocks by their remainder. All numbers of a series have the remainder of one block, so its ratings and factors stay there, and a
    block holds a share of the series; a long series has numbers one after another, behind all others, and is spread over all blocks.
    """
    n = F.col("n")
    half = F.floor(n / 2)
    tops = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("series_id", (half - 1).alias("j"), (n - half).alias("k"))
    total, cells = tops.agg(F.sum(F.greatest("j", "k") + 1), F.sum((F.col("j") + 1.0) * (F.col("k") + 1))).first()
    blocks = min(BLOCKS, max(10, math.ceil((cells or 0) / CELLS)))
    share = max(1, math.ceil((total or 0) / blocks))
    start, block = F.col("start"), F.floor(F.col("start") / share)
    at = lambda c: F.when(F.col("short"), (start - block * share + c) * blocks + block).otherwise((share + LONG) * blocks + start + c).cast("int")
    # merged, as both are dealt by series: judged by its file's size, the embedding, many times larger, would be broadcast through the driver
    sizes = tops.select("series_id", (F.greatest("j", "k") < LONG).alias("short"))
    ranges = _ranges(tops).join(sizes.hint("merge"), "series_id")
    h = native.hankel_embed(df, ("series_id",), value=value)
    return h.join(ranges.hint("merge"), "series_id").select("series_id", "j", "k", "value", at(F.col("j")).alias("u"), at(F.col("k")).alias("v")), blocks


def hankel_als(df: DataFrame, rank: int = 4, reg: float = 0.01, max_iter: int = 5, value: str = "obs") -> DataFrame:
    """``(series_id, idx, value)``: the Hankel matrix of all series factorised together by ``pyspark.ml`` ALS, its rows and
    columns numbered apart per series, then averaged along anti-diagonals. For series too long for one kernel.

    ALS numbers are ints, so each series has a range of its own, whatever its id; rows of
    all series beyond 2**30 may raise an overflow. A null series_id has no range and goes.
    """
    from pyspark.ml.recommendation import ALS

    cells, blocks = _numbered(df, value)
    als = ALS(rank=rank, regParam=reg, maxIter=max_iter, userCol="u", itemCol="v", ratingCol="value", seed=0, numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(cells.where("value IS NOT NULL").withColumn("value", F.col("value").cast("float")))
    # the model's own transform lets its factors, which grow with the input, be broadcast through the driver
    factors = lambda df, key, name: df.select(F.col("id").alias(key), F.col("features").alias(name)).hint("merge")
    scored = cells.drop("value").join(factors(model.userFactors, "u", "a"), "u", "left").join(factors(model.itemFactors, "v", "b"), "v", "left")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    return native.hankel_deembed(scored.select("series_id", "j", "k", F.coalesce(dot, F.lit(float("nan"))).alias("value")))
