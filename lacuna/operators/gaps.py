"""Missingness: injection, stored masks, run detection and summaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import in_series, put, whole_series

#: Multiplier of the deterministic mask (Knuth's multiplicative hash).
HASH_MULTIPLIER = 2654435761


def hash_mask(df: DataFrame, fractions: Sequence[float] = (0.1, 0.3, 0.5), id_col: str = "event_id", value: str = "flux", block: int = 0, order: Sequence[str] = ("t", "event_id"), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``df`` once per fraction, with ``is_missing``, ``obs`` and ``truth``: a deterministic mask any SQL engine repeats.

    ``block`` > 0 masks whole runs of that many rows instead of single ones. The fractions are a literal array, so
    rows multiply inside the scan's stage.
    """
    permille = F.explode(F.array(*[F.lit(round(1000 * p)) for p in fractions]))
    x = df
    narrow = lambda c: F.pmod(F.col(c).cast("long"), F.lit(1000))  # noqa: E731 - same remainder of the product, without overflow
    source = narrow(id_col)
    if block:
        w = Window.partitionBy(*keys).orderBy(*order)
        x = x.withColumn("_b", F.floor((F.row_number().over(w) - 1) / F.lit(block)).cast("long"))
        source = narrow("_b") * 7919 + narrow(keys[0])
    x = x.withColumn("_m", permille)
    missing = F.pmod(source * F.lit(HASH_MULTIPLIER), F.lit(1000)) < F.col("_m")
    return x.select(
        *[c for c in df.columns], (F.col("_m") / F.lit(1000.0)).alias("fraction"), missing.alias("is_missing"),
        F.when(~missing, F.col(value)).alias("obs"), F.col(value).alias("truth"))


def apply_mask(series: DataFrame, mask: DataFrame, on: Sequence[str] = ("idx",), value: str = "flux") -> DataFrame:
    """A stored 0/1 mask (1: observed) as NULLs in ``obs``."""
    return series.join(mask.select(*on, "mask"), list(on)).withColumn("obs", F.when(F.col("mask") == 1, F.col(value))).withColumn("is_missing", F.col("mask") != 1)


def gap_runs(df: DataFrame, keys: Sequence[str] = ("series_id", "fraction"), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    """``(*keys, start, length)`` of the runs of missing rows, a trailing one included: gaps and islands over one window."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1)
    own = Window.partitionBy(*keys, "is_missing").orderBy(*order)
    missing = numbered.where("is_missing").withColumn("_k", F.col("_i") - F.row_number().over(own))
    return missing.groupBy(*keys, "_k").agg(F.min("_i").cast("long").alias("start"), F.count(F.lit(1)).alias("length")).drop("_k")


def gap_stats(runs: DataFrame, by: Sequence[str] = ("fraction",)) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"), F.expr("percentile(length, 0.5)").alias("median_length"), F.stddev_pop("length").alias("std_length"))


def missing_summary(df: DataFrame, by: Sequence[str] = ("fraction",), value: str = "obs") -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("total"), F.count(value).alias("observed"), (n - F.count(value)).alias("missing"), (100.0 * (n - F.count(value)) / n).alias("pct_missing"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null)`` in one pass."""
    cols = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "n_null")


def missing_positions(df: DataFrame, keys: Sequence[str] = ("series_id", "fraction"), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("idx", F.row_number().over(w) - 1).where("is_missing").select(*keys, "idx")


def key_seed(key) -> int:
    """32 bits of one value of a group's key, the same in every process; nulls are 0."""
    if key is None or key != key:
        return 0
    if isinstance(key, (int, float, np.number)):
        return int(round(float(key) * 1000)) & 0xFFFFFFFF
    return zlib.crc32(str(key).encode())


def gap_mask(n: int, p: float, rng: np.random.Generator, block_ratio: float = 0.5, shortest: int = 5, longest: int = 50, variant: str = "index") -> np.ndarray:
    """True where missing. ``index``: floor(pn) in all, blocks that never reach the last sample; ``mask``: blocks may,
    p unchecked; ``exact``: round(pn), blocks trimmed in index order to their exact share. Blocks that find no
    room in 10 n attempts leave the rest to single samples."""
    if variant not in ("index", "mask", "exact"):
        raise ValueError(f"unknown variant {variant!r}")
    if variant != "mask" and not 0 < p < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    total = round(n * p) if variant == "exact" else int(p * n)
    in_blocks = int(block_ratio * total)
    out = np.zeros(n, dtype=bool)
    tries = 0
    while out.sum() < in_blocks and tries < 10 * n:
        size = int(rng.integers(shortest, longest + 1))
        high = n - size + (1 if variant == "mask" else 0)
        start = int(rng.integers(0, max(1, high)))
        out[start:start + size] = True
        tries += 1
    if variant == "exact":
        out[np.flatnonzero(out)[in_blocks:]] = False
    rest = total - int(out.sum())
    if rest > 0:
        out[rng.choice(np.flatnonzero(~out), size=rest, replace=False)] = True
    return out


def inject_gaps(df: DataFrame, fractions: Sequence[float], seeds: Sequence[int], variant: str = "index", keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("t",), value: str = "flux", **options) -> DataFrame:
    """``df`` once per (fraction, seed), with ``is_missing``, ``obs``, ``truth``: random blocks and scattered gaps.

    Rows are dealt and sorted by series once; a task draws all masks of a series and writes it once for each. The injected gaps
    depend on (series, fraction, seed) alone.
    """
    if variant != "mask" and any(not 0 < p < 1 for p in fractions):
        raise ValueError("fractions must lie between 0 and 1")
    runs = [(float(p), int(s)) for p in fractions for s in seeds]
    extra = {"fraction": F.lit(0.0), "seed": F.lit(0).cast("long"), "is_missing": F.lit(False), "obs": F.col(value), "truth": F.col(value)}
    schema = df.withColumns(extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends, names in whole_series(batches, keys):
            own = [[key_seed(k) for k in name] for name in names]
            truth = table[value]
            for p, seed in runs:
                rngs = (np.random.default_rng([seed & 0xFFFFFFFF, round(p * 1000), *k]) for k in own)
                gone = pa.array(np.concatenate([gap_mask(n, p, rng, variant=variant, **options) for n, rng in zip(np.diff(ends), rngs)]))
                size = table.num_rows
                one = table
                for name, values in (("fraction", pa.array(np.full(size, p))), ("seed", pa.array(np.full(size, seed, dtype=np.int64))), ("is_missing", gone),
                                     ("obs", pc.if_else(gone, pa.scalar(None, truth.type), truth)), ("truth", truth)):
                    one = put(one, name, values)
                yield from one.to_batches(max_chunksize=10_000)

    return in_series(df, keys, order).mapInArrow(run, schema)
