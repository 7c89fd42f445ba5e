"""Preprocessing of series: segments, offsets, clipping, normalisation, windows, samples, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order as ordering

KEYS, ORDER = ("series",), ("t",)


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def segments(df: DataFrame, factor: float = 10.0, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds ``segment``: a new one where a step exceeds ``factor`` times the series' median step."""
    w = _w(keys, order)
    x = df.withColumn("_dt", F.col(order[0]) - F.lag(order[0]).over(w))
    x = x.withColumn("_med", F.median("_dt").over(Window.partitionBy(*keys)))
    new = F.when(F.col("_dt") > factor * F.col("_med"), 1).otherwise(0)
    return x.withColumn("segment", F.sum(new).over(w).cast("int")).drop("_dt", "_med")


def offset_correct(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "flux") -> DataFrame:
    """Moves every segment's median to the series' median; missing values are ignored."""
    return df.withColumn(value, F.col(value) - F.median(value).over(Window.partitionBy(*keys, "segment")) + F.median(value).over(Window.partitionBy(*keys)))


def rolling_median(df: DataFrame, window: int = 30, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "flux", out: str = "rolling") -> DataFrame:
    """Centred, at the edges over what there is; an even window reaches one row further back."""
    frame = _w(keys, order).rowsBetween(-(window // 2), window - window // 2 - 1)
    return df.withColumn(out, F.percentile(value, F.lit(0.5)).over(frame))


def sigma_clip(df: DataFrame, sigma: float = 5.0, window: int = 30, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "flux") -> DataFrame:
    """Keeps rows within ``sigma`` robust deviations of the rolling median; a zero deviation clips nothing."""
    whole = Window.partitionBy(*keys)
    x = rolling_median(df, window, keys, order, value, "_roll").withColumn("_res", F.col(value) - F.col("_roll"))
    x = x.withColumn("_mid", F.median("_res").over(whole)).withColumn("_mad", F.median(F.abs(F.col("_res") - F.col("_mid"))).over(whole))
    keep = (F.col("_mad") == 0) | (F.abs("_res") <= sigma * F.col("_mad") / 0.6745)
    return x.where(keep).select(*df.columns)


def quality_filter(df: DataFrame, column: str | None, good: int = 0) -> DataFrame:
    return df.where(F.col(column) == good) if column else df


def median_normalise(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "flux", error: str | None = None) -> DataFrame:
    """Divides by the series' median; a median of zero, or none, is an error."""
    med = F.median(value).over(Window.partitionBy(*keys))
    x = df.withColumn("_med", med)
    ok = F.when(F.col("_med").isNull() | (F.col("_med") == 0), F.raise_error(F.lit("the median is zero or undefined")).cast("double")).otherwise(F.col("_med"))
    x = x.withColumn("_med", ok)
    for c in [value, *([error] if error else [])]:
        x = x.withColumn(c, F.col(c) / F.col("_med"))
    return x.drop("_med")


def preprocess(df: DataFrame, sigma: float = 5.0, window: int = 30, quality: str | None = None, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "flux", error: str | None = None) -> DataFrame:
    """Segments, offset correction, clipping, quality filter, normalisation, and no missing values left."""
    x = offset_correct(segments(df, keys=keys, order=order), keys, value)
    x = quality_filter(sigma_clip(x, sigma, window, keys, order, value), quality)
    return median_normalise(x, keys, value, error).where(F.col(value).isNotNull())


def truncate(df: DataFrame, n: int, strategy: str = "first", compat: bool = False, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "obs") -> DataFrame:
    """``n`` rows of each series: the first, the middle, or the earliest window with the most observed values.

    Series of at most ``n`` rows are unchanged. ``compat`` counts a dense window one row late and never tries the last one, as an
    older implementation did.
    """
    if strategy not in ("first", "middle", "densest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    w, whole = _w(keys, order), Window.partitionBy(*keys)
    x = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    if strategy == "first":
        start: Column = F.lit(0)
    elif strategy == "middle":
        start = F.floor((F.col("_n") - n) / 2)
    else:
        ahead = w.rowsBetween(1 if compat else 0, n if compat else n - 1)
        last = F.col("_n") - n - (1 if compat else 0)
        x = x.withColumn("_c", F.count(value).over(ahead))
        best = F.max(F.when(F.col("_i") <= last, F.struct(F.col("_c"), -F.col("_i")))).over(whole)
        x = x.withColumn("_s", -best["col2"])
        start = F.coalesce(F.col("_s"), F.lit(0))
    keep = (F.col("_n") <= n) | ((F.col("_i") >= start) & (F.col("_i") < start + n))
    return x.where(keep).select(*df.columns)


OWN = ("_ties", "_rank", "_n")
#: Prime range of the hash that orders rows of a class.
HASH_RANGE = 1000003


def _hashed(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("_h", F.pmod(F.pmod(F.col(id_col).cast("long"), F.lit(HASH_RANGE)) * F.lit(2654435761 % HASH_RANGE), F.lit(HASH_RANGE)))


def _by_hash(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """``df`` plus ``_rank``, ``_ties`` and ``_n`` of its rows in their class by a hash of the id: hash ranges bound a task, whatever the class."""
    return ordering.with_ranks(_hashed(df, id_col), [label], ["_h", id_col], OWN, span=(0, HASH_RANGE))


def sample_per_class(df: DataFrame, k: int, label: str = "label", id_col: str = "event_id") -> DataFrame:
    """At most ``k`` rows a class, by a hash of the id. Rows of one id are taken while all of them fit, so a class of few ids may give fewer."""
    return _by_hash(df, label, id_col).where(F.col("_rank") + F.col("_ties") - 1 <= k).select(*df.columns)


def stratified_split(df: DataFrame, test_share: float = 0.3, label: str = "label", id_col: str = "event_id") -> DataFrame:
    """Adds ``is_test``: the same share of every class, by a hash of the id. Rows of one id are never torn apart: they go where the first of them goes."""
    x = _by_hash(df, label, id_col)
    return x.select(*df.columns, (F.col("_rank") <= F.floor(F.col("_n") * F.lit(test_share))).alias("is_test"))


def split(df: DataFrame, shares: dict[str, float], label: Sequence[str], id_col: str) -> DataFrame:
    """Adds ``split``, one of the names of ``shares`` (which add up to 1), each in its share of every class. ``id_col`` holds evenly spread
    whole numbers under 2^60, such as digests; equal ones stay together."""
    x = ordering.with_ranks(df, label, [id_col], OWN, span=(0, 1 << 60))
    done, names = 0.0, list(shares)
    out: Column = F.lit(None).cast("string")
    for name in names:
        done += shares[name]
        mine = F.lit(True) if name == names[-1] else F.col("_rank") <= F.floor(F.col("_n") * F.lit(round(done, 9)))
        out = F.coalesce(out, F.when(mine, F.lit(name)))
    return x.select(*df.columns, out.alias("split"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
