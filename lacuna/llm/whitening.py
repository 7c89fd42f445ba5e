"""Embedding whitening: MLlib's Gramian of exactly centred rows, local eigenvectors, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: x = floor(SCALE * c) + SHIFT (fixed by the contract).
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of so large a magnitude count as non-finite: their sums would not fit a long.
LARGEST = 1 << 30
#: Eigenvalues under this share of the largest are zero.
FLAT = 1e-12


@dataclass(frozen=True)
class Moments:
    """Exact count and per-dimension sums of the x-vectors; the mean split in a whole and a broken part, so that centring rounds once."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` with x an array of longs. Rows whose vector is null, empty, or holds a null, a non-finite or a huge entry (2^30) go."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LARGEST))))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def moments(rows: DataFrame) -> Moments | None:
    """Count and sums of the rows of the most common dimension (of equally common ones the largest); None without rows.

    A task adds up its batches in longs and emits one row a dimension count; those few rows are summed by position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, x in _by_size(batch.column(0)):
                n, s = total.get(d, (0, 0))
                total[d] = [n + len(x), s + x.sum(axis=0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], names=["d", "n", "s"])

    parts = rows.select("x").mapInArrow(run, "d int, n long, s array<long>")
    found = parts.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy(F.desc("n"), F.desc("d"), "i")
    # one row a dimension: as many as a vector is long, for each length that occurs
    first = found.limit(1).collect()
    if not first:
        return None
    sums = found.where(F.col("d") == first[0]["d"]).collect()
    return Moments(first[0]["n"], tuple(r["s"] for r in sums))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows x length) of each length that a list column holds."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = starts[sizes == d]
        yield int(d), flat[at[:, None] + np.arange(d)]


def centred(x: Column, m: Moments) -> Column:
    """x - S / n as doubles: the whole part of the mean goes first, exactly, so only its fraction is rounded."""
    mean = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(r / m.n).alias("r")) for q, r in zip(m.whole, m.rest)])
    return F.zip_with(x, mean, lambda e, s: (e - s["q"]).cast("double") - s["r"])


def covariance(rows: DataFrame, column: Column, n: int) -> np.ndarray:
    """Gramian of an array column of centred doubles by MLlib, over n. The driver and each task hold d (d + 1) / 2 doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling, at most ``count``; each vector's largest entry is positive, flat eigenvalues are 0."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return np.where(e > FLAT * max(e[0], 0.0), e, 0.0), u


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``(vec_id, deviation, whitened, n, eigenvalues, trace, identity_error)``, one row a remaining vector, staged.

    ``whitened`` holds up to ``count`` projections over the square roots of their eigenvalues, null where the eigenvalue is 0 (fewer independent
    rows than components). Vectors of another length than the most common one go, like those ``scaled`` drops. ``deviation`` is the exact
    sum of (n x - S)^2, null where that exceeds a long. Repeated rows, ties and null ids stay; other columns are
    ignored, whatever their names; no remaining rows give an empty result. Three narrow passes over the vectors; only sums, a matrix and the eigenvectors reach the driver.
    """
    spark = vectors.sparkSession
    schema = "vec_id {}, deviation long, whitened array<double>".format(dict(vectors.dtypes)[id_col])
    tail = [("n", "long"), ("eigenvalues", "array<double>"), ("trace", "double"), ("identity_error", "double")]
    rows = scaled(vectors, id_col, vector_col)
    m = moments(rows)
    if m is None:
        return spark.createDataFrame([], schema + "".join(f", {c} {k}" for c, k in tail))
    rows = rows.where(F.size("x") == len(m.sums))
    v = covariance(rows, centred(F.col("x"), m), m.n)
    e, u = components(v, count)
    scale = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), np.nan)
    shared = spark.sparkContext.broadcast((m.n, np.array(m.whole), np.array(m.rest), u * scale))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, whole, rest, project = shared.value
        for f in frames:
            if not len(f):
                continue
            off = np.stack(f["x"].to_numpy()) - whole
            most = int(np.abs(off).max()) * n + n
            if most * most * off.shape[1] < 1 << 63:
                deviation = pd.Series(((n * off - rest) ** 2).sum(axis=1), dtype="Int64")
            else:  # whole numbers of any size
                exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in off]
                deviation = pd.Series([x if x < 1 << 63 else pd.NA for x in exact], dtype="Int64")
            y = (off - rest / n) @ project
            yield pd.DataFrame({"vec_id": f["vec_id"].to_numpy(), "deviation": deviation.to_numpy(dtype=object, na_value=None), "whitened": [[None if np.isnan(z) else z for z in row] for row in y.tolist()]})

    out = stage(rows.mapInPandas(run, schema), "whitened")
    good = int((e > 0).sum())
    error = None
    if good:
        means = out.select([F.avg(F.get("whitened", F.lit(j))).alias(f"m{j}") for j in range(good)]).first()
        own = F.array(*[F.get("whitened", F.lit(j)) - F.lit(means[j]) for j in range(good)])
        error = float(np.abs(covariance(out, own, m.n) - np.eye(good)).max())
    values = {"n": F.lit(m.n), "eigenvalues": F.array(*map(F.lit, e.tolist())), "trace": F.lit(float(np.trace(v))), "identity_error": F.lit(error)}
    return out.select("*", *[values[c].cast(k).alias(c) for c, k in tail])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per remaining vector and component."""
    w = whiten(table(spark, sf_dir, "embeddings"))
    long = w.select("*", F.posexplode("whitened").alias("at", "value"))
    explained = F.when(F.col("trace") > 0, F.get("eigenvalues", F.col("at")) / F.col("trace")).otherwise(F.lit(0.0))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), explained.alias("explained"), "identity_error")
