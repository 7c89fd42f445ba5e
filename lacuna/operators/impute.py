"""Imputation with windows and joins: mean, carried, linear, nearest neighbours; lag matrices and Hankel embedding.

All functions read ``obs`` (NULL where missing) and add ``imputed``; observed values never change. They share one window
specification a series, so Spark plans one exchange and one sort for a chain of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS, ORDER = ("series_id", "fraction"), ("t", "event_id")
#: Rows of a task, about, where a plan deals its series itself.
TASK_ROWS = 200_000


def dealt(df: DataFrame, keys: Sequence[str] = KEYS, rows: int | None = None, least: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about ``rows`` rows, ``least`` or more (the default parallelism), so that a task's memory doesn't grow with the input.

    Windows over ``keys`` need no other exchange, and adaptive execution leaves a given number alone. Keys that are fractional numbers
    take no part if there are others: windows compare those in a normal form, which another exchange would have to make. The rows are counted
    first, in a pass that reads no column a frame of files doesn't need for it. A series, with all its fractions, bounds a task.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    kinds = dict(df.dtypes)
    whole = [k for k in keys if kinds[k] not in ("double", "float")] or list(keys)
    return df.repartition(max(least, math.ceil(df.count() / (rows or TASK_ROWS))), *whole)


def _windows(keys: Sequence[str], order: Sequence[str]):
    """The series' order; up to a row; from a row on, as the same frame in reverse order (a frame that ends at the last row costs the square of a series' length); the whole series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    lo, hi, now = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow
    return w, w.rowsBetween(lo, now), back.rowsBetween(lo, now), w.rowsBetween(lo, hi)


def mean_fill(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("imputed", F.coalesce("obs", F.avg("obs").over(Window.partitionBy(*keys))))


def forward_fill(df: DataFrame, backfill: bool = True, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Last observation carried forward; leading gaps take the first observation, or stay NULL without ``backfill``."""
    _, past, ahead, _ = _windows(keys, order)
    last = F.last("obs", ignorenulls=True).over(past)
    return df.withColumn("imputed", F.coalesce(last, F.last("obs", ignorenulls=True).over(ahead)) if backfill else last)


def _between(x: Column, a: Column, b: Column) -> Column:
    return a["f"] + (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) * (b["f"] - a["f"])


def linear(df: DataFrame, ends: str = "extrapolate", by: str = "t", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Piecewise linear in time (``by="t"``) or row number (``by="index"``).

    ``ends``: ``extrapolate`` along the two outermost observations, or ``clamp`` to the outermost. A series with fewer than
    two observations gets its mean.
    """
    if ends not in ("extrapolate", "clamp") or by not in ("t", "index"):
        raise ValueError("ends: extrapolate or clamp; by: t or index")
    w, past, ahead, whole = _windows(keys, order)
    x = (F.row_number().over(w).cast("double") if by == "index" else F.col(order[0]))
    d = df.withColumn("_x", x)
    point = F.when(F.col("obs").isNotNull(), F.struct(F.col("_x").alias("x"), F.col("obs").alias("f")))
    d = d.withColumn("_p", point)
    # windows of one order follow each other, so each order is sorted once
    behind, before = {"_b": F.last("_p", ignorenulls=True).over(ahead)}, {"_a": F.last("_p", ignorenulls=True).over(past)}
    if ends != "clamp":
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        behind["_l2"], before["_f2"] = F.nth_value("_p", 2, True).over(back), F.nth_value("_p", 2, True).over(whole)
    d = d.withColumns(behind).withColumns(before)
    mid = _between(F.col("_x"), F.col("_a"), F.col("_b"))
    if ends == "clamp":
        low, high = F.col("_b")["f"], F.col("_a")["f"]
    else:
        low, high = _between(F.col("_x"), F.col("_b"), F.col("_f2")), _between(F.col("_x"), F.col("_l2"), F.col("_a"))
    est = F.when(F.col("_a").isNull(), low).when(F.col("_b").isNull(), high).otherwise(F.coalesce(mid, F.col("_a")["f"]))
    return d.withColumn("imputed", F.coalesce("obs", est, F.avg("obs").over(Window.partitionBy(*keys)))).drop("_x", "_p", "_a", "_b", "_f2", "_l2")


def lag_phase_matrix(df: DataFrame, L: int = 5, period: Column | float = 1.0, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, value: str = "obs") -> DataFrame:
    """Adds ``lag0, lag1, lead1, .., lagL, leadL, sin, cos``, NULL beyond the edges."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = F.lit(float(period)) if not isinstance(period, Column) else period
    x = F.lit(6.283185307179586) * F.col(order[0]) / p
    new = {"lag0": F.col(value)}
    for k in range(1, L + 1):
        new |= {f"lag{k}": F.lag(value, k).over(w), f"lead{k}": F.lead(value, k).over(w)}
    return df.withColumns(new | {"sin": F.sin(x), "cos": F.cos(x)})


def _neighbourhoods(df: DataFrame, W: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` plus its row number ``_i``, the 2 W values around each row ``_d`` (rows i - W to i + W - 1) and how many of them are there ``_c``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    slots = F.array(*[(F.lag("obs", W - j) if j < W else F.lead("obs", j - W)).over(w) for j in range(2 * W)])
    return df.withColumn("_i", F.row_number().over(w)).withColumn("_d", slots).withColumn("_c", F.count("obs").over(w.rowsBetween(-W, W - 1)))


def _nearest(pairs: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The ``k`` rows of each target with the least ``(d, i)``; a task keeps k a target before the exchange."""
    w = Window.partitionBy(*keys, "_i").orderBy("d", "i")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _gap() -> Column:
    return F.sqrt(F.aggregate(F.zip_with("_d", "k_d", lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x))


def _indexed_pairs(targets: DataFrame, donors: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """``(*keys, _i, d, i, f)``: pairs among which every target's ``k`` nearest donors are, without meeting all donors.

    Donors are dealt to some sqrt(n) / 2 blocks by level and slope of their neighbourhoods; a block is known by the range of each slot. The distance to
    that box over the slots a target has is a lower bound, whatever it lacks. A target meets the block with the least bound first; its k-th distance there is an
    upper bound for all others, and only blocks whose lower bound reaches no further are met. Smooth series meet few; noise meets most, and stays exact.
    """
    names = list(keys)
    half = F.size("k_d") / 2
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    x = donors.withColumn("_level", total(F.col("k_d"))).withColumn("_slope", F.col("_level") - 2 * total(F.slice("k_d", 1, half.cast("int"))))
    n = F.count(F.lit(1)).over(Window.partitionBy(*names))
    side = F.greatest(F.lit(1), F.floor(F.sqrt(F.sqrt(n) / 2))).cast("int")  # blocks along each of the two directions
    x = x.withColumn("_side", side).withColumn("_u", F.floor((F.row_number().over(Window.partitionBy(*names).orderBy("_level", "k_i")) - 1) * F.col("_side") / n).cast("int"))
    inner = Window.partitionBy(*names, "_u")
    v = F.floor((F.row_number().over(inner.orderBy("_slope", "k_i")) - 1) * F.col("_side") / F.count(F.lit(1)).over(inner)).cast("int")
    x = x.withColumn("_b", F.col("_u") * F.col("_side") + v).select(*names, "_b", "k_d", "k_obs", "k_i")
    slots = x.select(*names, "_b", F.posexplode("k_d").alias("_j", "_v")).groupBy(*names, "_b", "_j").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    boxes = slots.groupBy(*names, "_b").agg(F.array_sort(F.collect_list(F.struct("_j", "lo", "hi"))).alias("_box"))  # 2 W entries a block

    outside = F.zip_with("_d", "_box", lambda a, b: F.coalesce(F.pow(F.greatest(b["lo"] - a, a - b["hi"], F.lit(0.0)), 2.0), F.lit(0.0)))
    middle = F.zip_with("_d", "_box", lambda a, b: F.coalesce(F.pow(a - (b["lo"] + b["hi"]) / 2, 2.0), F.lit(0.0)))
    known = F.zip_with("_d", "_d", lambda a, b: F.when(a.isNotNull(), 1.0).otherwise(0.0))
    # greatest skips nulls, so a slot the target lacks would count as outside unless it is masked
    bound = F.aggregate(F.zip_with(outside, known, lambda a, m: a * m), F.lit(0.0), lambda acc, z: acc + z)
    near = targets.join(boxes, names).select(*names, "_i", F.struct(bound.alias("lb"), total(middle).alias("m"), "_b").alias("s"))
    ordered = near.groupBy(*names, "_i").agg(F.array_sort(F.collect_list("s")).alias("_s"))  # sqrt(n) / 2 blocks
    homed = targets.join(ordered, [*names, "_i"]).withColumn("_b", F.col("_s")[0]["_b"])
    pair = lambda t: t.join(x, [*names, "_b"]).select(*names, "_i", _gap().alias("d"), F.col("k_i").alias("i"), F.col("k_obs").alias("f"))
    home = _nearest(pair(homed), k, names)
    reach = home.groupBy(*names, "_i").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("_reach"))
    others = homed.join(reach, [*names, "_i"]).select(*names, "_i", "_d", "_reach", F.explode(F.slice("_s", F.lit(2), F.size("_s"))).alias("_o"))
    others = others.where(F.col("_reach").isNull() | (F.sqrt("_o.lb") * (1 - 1e-9) <= F.col("_reach"))).withColumn("_b", F.col("_o._b"))
    return home.unionByName(_nearest(pair(others), k, names))


def knn(df: DataFrame, k: int = 5, W: int = 10, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, index: bool = False) -> DataFrame:
    """Weighted mean of the ``k`` donors whose neighbourhoods (rows i-W to i+W-1) are nearest.

    Donors are observed rows with a complete neighbourhood; distances run over the target's observed slots; weights are
    1 / (distance + 1e-8). Targets without context or donors get the mean; null keys too. Donors and targets of a series meet in an
    equi-join on the series: all of them, or with ``index`` (for series of many thousand rows) those that block bounds can't rule out. The result is the same.
    """
    d = _neighbourhoods(df, W, keys, order)
    donors = d.where((F.col("_c") == 2 * W) & F.col("obs").isNotNull()).select(*keys, F.col("_d").alias("k_d"), F.col("obs").alias("k_obs"), F.col("_i").alias("k_i"))
    targets = d.where("obs IS NULL AND _c > 0").select(*keys, "_i", "_d")
    if index:
        pairs = _indexed_pairs(targets, donors, k, keys)
    else:
        pairs = targets.join(donors, list(keys)).select(*keys, "_i", _gap().alias("d"), F.col("k_i").alias("i"), F.col("k_obs").alias("f"))
    est = _nearest(pairs, k, keys).groupBy(*keys, "_i").agg((F.sum(F.col("f") / (F.col("d") + 1e-8)) / F.sum(1 / (F.col("d") + 1e-8))).alias("_est"))
    out = d.join(est, [*keys, "_i"], "left")
    return out.withColumn("imputed", F.coalesce("obs", "_est", F.avg("obs").over(Window.partitionBy(*keys)))).drop("_i", "_d", "_c", "_est")


def hankel_embed(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("t", "event_id"), value: str = "flux") -> DataFrame:
    """``(*keys, j, k, value)`` of the D x (N-D+1) Hankel matrix, D = N // 2: each sample enters its anti-diagonal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_i", (F.row_number().over(w) - 1).cast("int")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
    D = F.floor(F.col("_n") / 2).cast("int")
    lo = F.greatest(F.lit(0), F.col("_i") - (F.col("_n") - D))
    hi = F.least(D - 1, F.col("_i"))
    rows = x.where(D > 0).select(*keys, F.explode(F.sequence(lo, hi)).alias("j"), "_i", F.col(value).alias("value"))
    return rows.select(*keys, F.col("j").cast("long").alias("j"), (F.col("_i") - F.col("j")).cast("long").alias("k"), "value")


def hankel_deembed(h: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(*keys, idx, value)``: anti-diagonal means."""
    return h.groupBy(*keys, (F.col("j") + F.col("k")).alias("idx")).agg(F.avg("value").alias("value"))
