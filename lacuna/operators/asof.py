"""As-of joins: each left row meets the last, next or nearest right row in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import BUCKETS, ROWS, joined


def _number(df: DataFrame, column: str) -> Column:
    """Times as numbers: microseconds of timestamps, days of dates."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def _carried(rows: DataFrame, keys: list[str], order: list[Column], backward: bool, limit: int, buckets: int) -> DataFrame:
    """``rows`` plus ``_hit``, the last right row up to each row in the given direction.

    One exchange and one sort a key. Keys of more than ``limit`` rows are cut into time buckets of their own (a sketch of quantiles gives the edges), so
    that a hot key is many tasks; the last right row of the buckets before is carried into each.
    """
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.percentile_approx(F.col("_n").cast("double"), [i / buckets for i in range(1, buckets)], 100 * buckets).alias("_edges"))
    x = joined(rows, edges.where(F.col("_size") > limit).drop("_size"), keys, "left")
    below = F.size(F.filter("_edges", lambda e: e < F.col("_n").cast("double")))
    # rows without a key or time match nothing: any bucket will do
    lost = F.pmod(F.xxhash64("_l"), F.lit(buckets)).cast("int")
    x = x.withColumn("_bucket", F.when(F.col("_lost"), lost).when(F.col("_edges").isNull(), F.lit(0)).otherwise(below)).withColumn("_hot", F.col("_edges").isNotNull() & ~F.col("_lost")).drop("_edges")
    w = Window.partitionBy(*keys, "_bucket", "_lost").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = x.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    last = x.where(F.col("_hot") & F.col("_r").isNotNull()).groupBy(*keys, "_bucket").agg(F.max_by("_r", F.struct(F.col("_n") if backward else -F.col("_n"), "_tie")).alias("_edge"))
    every = x.where("_hot").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    before = Window.partitionBy(*keys).orderBy(F.col("_bucket") if backward else F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = joined(every, last, [*keys, "_bucket"], "left").withColumn("_carry", F.last("_edge", ignorenulls=True).over(before)).drop("_edge")
    out = joined(within, carry, [*keys, "_bucket"], "left")
    return out.withColumn("_hit", F.coalesce("_hit", F.when(~F.col("_lost"), F.col("_carry")))).drop("_carry")


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str | tuple[str, str]] = (), direction: str = "backward", tolerance: float | None = None,
    exact: bool = True, tie: Sequence[str] = (), how: str = "left", limit: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """Every left row with the columns of the right row that is nearest in time and equal in ``by`` (names, or (left, right) pairs).

    ``direction``: ``backward`` takes the last right row at or before the left time, ``forward`` the first at or after it, ``nearest`` the closer of both (of
    equally close ones the earlier). ``exact=False`` leaves out equal times. ``tolerance``: the largest distance, in seconds for timestamps, days for
    dates. Of right rows at one time the one with the greatest ``tie`` columns is taken (without them, any). ``how``: ``left`` or ``inner``.

    A merge, not a range join: both sides in one union, one exchange, one sort and one running value. Null keys and times match nothing; repeated left rows stay;
    an empty side gives nulls or no rows. Column names on both sides must differ, but for ``by`` columns of one name, which the result has once.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    if direction == "nearest" and not exact:
        raise ValueError("the nearest row may have the same time")
    pairs = [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    shared = {a for a, b in pairs if a == b}
    payload = [c for c in right.columns if c not in shared]
    if clash := set(left.columns) & set(payload):
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    keys = [f"_key{i}" for i in range(max(1, len(pairs)))]
    quoted = lambda cs: [F.col(f"`{c}`") for c in cs]
    unit = 1e6 if dict(left.dtypes)[left_on].startswith("timestamp") else 1
    a, b = F.struct(*quoted(left.columns)), F.struct(*quoted(payload))
    kinds = dict(right.dtypes)
    ties = F.struct(*quoted(tie)) if tie else F.struct(F.lit(0))

    def side(df: DataFrame, names: list[str], on: str, l: Column, r: Column, mine: Column) -> DataFrame:
        at = [F.col(f"`{n}`") for n in names] or [F.lit(0)]
        x = df.select(*[c.alias(k) for c, k in zip(at, keys)], _number(df, on).alias("_n"), l.alias("_l"), r.alias("_r"), mine.alias("_tie"))
        lost = F.col("_n").isNull()
        for k in keys:
            lost = lost | F.col(k).isNull()
        return x.withColumn("_lost", lost)

    no_l, no_r = F.lit(None).cast(left.select(a.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(b.alias("x")).schema["x"].dataType)
    no_tie = F.lit(None).cast(right.select(ties.alias("x")).schema["x"].dataType)
    ls = side(left, [p[0] for p in pairs], left_on, a, no_r, no_tie)
    rs = side(right, [p[1] for p in pairs], right_on, no_l, b, ties).where(~F.col("_lost"))

    def hits(rows: DataFrame, backward: bool, name: str) -> DataFrame:
        is_left = F.col("_l").isNotNull()
        order = [F.col("_n") if backward else F.col("_n").desc(), is_left if exact else ~is_left, F.col("_tie")]
        return _carried(rows, keys, order, backward, limit, buckets).withColumnRenamed("_hit", name).drop("_bucket", "_hot")

    rows = ls.unionByName(rs)
    if direction != "forward":
        rows = hits(rows, True, "_back")
    if direction != "backward":
        rows = hits(rows, False, "_next")
    rows = rows.where(F.col("_l").isNotNull())
    right_number = lambda c: F.unix_micros(c.cast("timestamp")) if kinds[right_on].startswith("timestamp") else F.unix_date(c) if kinds[right_on] == "date" else c
    away = lambda c: F.abs(F.col("_n") - right_number(F.col(f"{c}.`{right_on}`")))
    if direction == "nearest":
        closer = F.when(F.col("_back").isNull(), F.col("_next")).when(F.col("_next").isNull(), F.col("_back")).when(away("_next") < away("_back"), F.col("_next")).otherwise(F.col("_back"))
        rows = rows.withColumn("_hit", closer)
    else:
        rows = rows.withColumnRenamed("_back" if direction == "backward" else "_next", "_hit")
    if tolerance is not None:
        rows = rows.withColumn("_hit", F.when(away("_hit") <= F.lit(tolerance * unit), F.col("_hit")))
    if how == "inner":
        rows = rows.where(F.col("_hit").isNotNull())
    return rows.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.col(f"_hit.`{c}`").alias(c) for c in payload])
