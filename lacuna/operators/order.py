"""Ranks, quantiles and trimmed means of groups of any size: counts per value, range buckets, prefix sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a group is one bucket, and buckets of a larger one.
ROWS, BUCKETS = 1_000_000, 256


def joined(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` (unique by ``columns``); nulls meet."""
    right = b.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], *[c for c in b.columns if c not in columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)])
    return a.join(right, on, how).drop(*[f"_k{i}" for i in range(len(columns))])


def _bucketed(df: DataFrame, by: Sequence[str], key: str, rows: int, buckets: int, span: tuple[float, float] | None) -> DataFrame:
    """Adds ``_bucket``, which grows with ``key`` within a group. ``span``: the range of evenly spread keys, where no look at the rows is needed.

    Else a group's approximate quantiles (a sketch combined map-side) are the edges; groups of at most ``rows`` rows have none, so
    the edges are as many as rows / ``rows`` x ``buckets`` at most, whatever the number of groups.
    """
    if span:
        lo, hi = span
        b = F.floor((F.col(key).cast("double") - lo) * (buckets / (hi - lo)))
        return df.withColumn("_bucket", F.when(b.isNull(), -1).when(b < 0, 0).when(b >= buckets, buckets - 1).otherwise(b).cast("int"))
    at = [i / buckets for i in range(1, buckets)]
    edges = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.percentile_approx(F.col(key).cast("double"), at, 100 * buckets).alias("_edges"))
    edges = edges.where(F.col("_size") > rows).drop("_size")
    x = joined(df, edges, by, "left")
    below = F.size(F.filter("_edges", lambda e: e < F.col(key).cast("double")))
    return x.withColumn("_bucket", F.when(F.col("_edges").isNull() | F.col(key).isNull(), F.lit(0)).otherwise(below)).drop("_edges")


def ranked_values(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, rows: int = ROWS, buckets: int = BUCKETS, span: tuple[float, float] | None = None) -> DataFrame:
    """``(*by, *order, *sums, ties, rank, n)``: each distinct value of a group once, with its number of rows, the rank of the first of them, and the group's rows.

    Equal values are counted map-side first, so a value that most rows share is one row a task. The distinct values are cut into range
    buckets by the first of ``order`` (a number); one window task holds a bucket, and the buckets' totals (``buckets`` rows a group) give its offset.
    Nulls come first. ``sums``: further aggregates of the rows of a value. No rows give no rows.
    """
    keys = list(by) or ["_all"]
    x = df if by else df.withColumn("_all", F.lit(0))
    counted = _bucketed(x, keys, order[0], rows, buckets, span).groupBy(*keys, "_bucket", *order).agg(F.count(F.lit(1)).alias("ties"), *[c.alias(k) for k, c in (sums or {}).items()])
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counted.groupBy(*keys, "_bucket").agg(F.sum("ties").alias("_t"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*keys, "_bucket", (F.sum("_t").over(ahead) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy(*keys)).alias("n"))
    placed = counted.withColumn("rank", F.sum("ties").over(within) - F.col("ties") + 1)
    out = joined(placed, offsets, [*keys, "_bucket"])
    return out.select(*by, *order, *(sums or {}), "ties", (F.col("rank") + F.col("_before")).alias("rank"), "n")


def with_ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], names: Sequence[str] = ("ties", "rank", "n"), **options) -> DataFrame:
    """``df`` plus ``ties``, ``rank`` (of the first equal row) and ``n``, under other ``names`` where ``df`` has such columns. A value that many rows share is one row on the other side of the join, which adaptive execution splits."""
    return joined(df, ranked_values(df, by, order, **options).withColumnsRenamed(dict(zip(("ties", "rank", "n"), names))), [*by, *order])


def _first_at(value: Column, index: Column) -> Column:
    """The value whose rows cover place ``index`` (from 0)."""
    return F.max(F.when((F.col("rank") - 1 <= index) & (index < F.col("rank") - 1 + F.col("ties")), value))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), **options) -> DataFrame:
    """``(*by, n, q)``: exact quantiles by linear interpolation as an array; nulls don't count, groups without values have no row."""
    r = ranked_values(df.where(F.col(value).isNotNull()), by, [value], **options)
    v, places = F.col(value).cast("double"), []
    for p in shares:
        h = F.lit(float(p)) * (F.col("n") - 1)
        places.append((h, _first_at(v, F.floor(h)), _first_at(v, F.ceil(h))))
    x = r.groupBy(*by).agg(F.max("n").alias("n"), *[c.alias(f"_{i}{s}") for i, (_, lo, hi) in enumerate(places) for s, c in (("l", lo), ("h", hi))])
    mixed = [F.col(f"_{i}l") + (F.col(f"_{i}h") - F.col(f"_{i}l")) * (h - F.floor(h)) for i, (h, _, _) in enumerate(places)]
    return x.select(*by, "n", F.array(*mixed).alias("q"))


def trimmed_mean(df: DataFrame, value: str, share: float = 0.05, by: Sequence[str] = (), **options) -> DataFrame:
    """``(*by, n, trimmed)``: the mean without floor(share n) rows at either end; of a value at the cut only the rows inside count."""
    r = ranked_values(df.where(F.col(value).isNotNull()), by, [value], **options)
    cut = F.floor(F.lit(float(share)) * F.col("n"))
    inside = F.greatest(F.lit(0), F.least(F.col("rank") - 1 + F.col("ties"), F.col("n") - cut) - F.greatest(F.col("rank") - 1, cut))
    return r.groupBy(*by).agg(F.max("n").alias("n"), (F.sum(F.col(value) * inside) / F.sum(inside)).alias("trimmed"))
