"""Whole series, many at a time, in Arrow: kernels of short series spend their time on calls, so a task takes a batch of series in one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch, about; a longer series is a batch of its own.
ROWS = 32_768


def in_series(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``keys`` and in order, so that a task meets its series one after another. The number of partitions is fixed: kernels cost far
    more than their bytes suggest, so small partitions must not be merged. Sorting spills; a task holds a batch."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])


def starts_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each series; null and NaN keys equal themselves."""
    new = np.ones(table.num_rows, dtype=bool)
    if len(new):
        new[1:] = False
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_series(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray, list[tuple]]]:
    """Tables of whole series of about ``rows`` rows, the bounds of the series (first rows, then the end) and their keys, from batches ordered by ``keys``."""

    def parts(t: pa.Table, starts: np.ndarray, end: int):
        heads = t.select(list(keys)).take(pa.array(starts)).to_pydict()
        return t.slice(0, end), np.r_[starts, end], list(zip(*[heads[k] for k in keys]))

    held, n, limit = [], 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(t, keys)
        if len(starts) > 1:
            yield parts(t, starts[:-1], int(starts[-1]))
        held, n = t.slice(int(starts[-1])).to_batches(), t.num_rows - int(starts[-1])
        limit = max(rows, 2 * n)  # a long series is looked at again once its rows have doubled
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield parts(t, starts_of(t, keys), t.num_rows)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Nulls are NaN."""
    return column.to_pandas().to_numpy(dtype=float)


def put(table: pa.Table, name: str, values) -> pa.Table:
    """``table`` with a column at its old place, or at the end."""
    if name in table.column_names:
        return table.set_column(table.column_names.index(name), name, values)
    return table.append_column(name, values)
