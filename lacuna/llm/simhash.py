"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .components import connected_components

SHINGLE, RADIUS, GROUPS = 4, 4, 7
#: The embedding: 32 segments of 2 bits, each replaced by its number of ones (0, 1 or 2),
#: kept in the same two bits of one long.
SEGMENTS, LOW = 32, 0x5555555555555555

#: Manhattan distance of the four segment counts in two bytes.
_lanes = np.array([[b >> s & 3 for s in (0, 2, 4, 6)] for b in range(256)], dtype=np.int8)
_APART = np.abs(_lanes[:, None, :] - _lanes[None, :, :]).sum(axis=2).astype(np.uint8)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is 1 if set in over half the shingle hashes."""
    words = text.lower().split()  # on bytes: lower-cases A-Z only and cuts at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1:])]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long; null texts count as texts with no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((x or "").encode()) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcount_embedding(fp) -> "F.Column":
    """The 32 segment counts of a fingerprint; two bits are added by their exclusive or and their carry."""
    low = F.lit(LOW)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_masks(radius: int = RADIUS, groups: int = GROUPS) -> list[int]:
    """Cell masks: of ``groups`` groups of coordinates a pair within Manhattan distance ``radius``
    agrees exactly on at least ``groups - radius``, so it shares a cell of one of these sub-grids."""
    if groups <= radius:
        raise ValueError("more groups than the radius are needed")
    edges = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    parts = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, groups - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings (uint64 arrays); never above the Hamming distance."""
    x, y = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    return _APART[x, y].sum(axis=1, dtype=np.int32)


def _embed(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW)
    return (fp & low) + (fp >> np.uint64(1) & low)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """True where the fingerprints (uint64) differ in at most ``radius`` bits: the lower bound first,
    the exact check on what it leaves."""
    near = np.flatnonzero(manhattan(_embed(a), _embed(b)) <= radius)
    out = np.zeros(len(a), dtype=bool)
    out[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
    return out


def cell_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of the links inside one cell (distinct fingerprints), as index pairs.

    Breadth first from one fingerprint at a time, always against those not reached yet: every
    link is either returned or joins two that returned links already connect. A dense cell of m is
    settled in few sweeps, and never gives more than m - 1 rows.
    """
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = close_pairs(np.full(len(left), fp[at], dtype=np.uint64), fp[left], radius)
            if hit.any():
                found, left = left[hit], left[~hit]
                out += [(at, x) for x in found]
                queue += list(found)
    return out


def _partition_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of one sorted partition of (cell, fp); a cell may continue in the next batch."""
    names = ["a", "b"]

    def solve(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[cut, len(cell)])
        left, right = [], []
        for at in cut[size == 2]:
            left.append(at)
            right.append(at + 1)
        if left:  # most shared cells hold two fingerprints: one vectorised check for all
            x, y = np.array(left), np.array(right)
            ok = close_pairs(fp[x], fp[y], radius)
            left, right = list(x[ok]), list(y[ok])
        for at, n in zip(cut[size > 2], size[size > 2]):
            for i, j in cell_links(fp[at:at + n], radius):
                left.append(at + i)
                right.append(at + j)
        if not left:
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[np.array(s)].view(np.int64)) for s in (left, right)], names=names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(cell, cell[-1]))  # sorted: the last cell may go on
        if last == 0 and held and held[-1][0][-1] == cell[0]:
            held.append((cell, fp))
            continue
        held.append((cell[:last], fp[:last]))
        done = solve(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        if done is not None:
            yield done
        held = [(cell[last:], fp[last:])]
    if held:
        done = solve(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        if done is not None:
            yield done


def near_links(distinct: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect whatever links of at
    most ``radius`` differing bits connect.

    Grid range-join under Manhattan distance: each fingerprint enters one cell per sub-grid
    (35 of them for 7 groups and radius 4); cells are dealt by hash, and a cell's rows meet in one sorted
    run. Cells hold distinct fingerprints that agree in 12 or more segment counts, so thousands of copies
    are one row here.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).cast("long").alias("m")) for i, m in enumerate(grid_masks(radius, groups))])
    cells = distinct.select("fp", popcount_embedding(F.col("fp")).alias("p")).select("fp", "p", F.explode(masks).alias("g")).select(
        F.xxhash64("g.i", F.col("p").bitwiseAND(F.col("g.m"))).alias("cell"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", "fp")
    return dealt.mapInArrow(lambda batches: _partition_links(batches, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row; component_id is the smallest doc_id reachable.

    Exact copies share a fingerprint and are one node (a grouped minimum, combined map-side). Null
    and wordless texts have fingerprint zero and link like any other. Rows with a null doc_id get
    the component of their fingerprint; repeated rows and ids stay; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    member = connected_components(near_links(nodes.select("fp"), radius, groups), "a", "b")
    joined = nodes.join(member, nodes.fp == member.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "component").select(F.col("fp").alias("node"), "component_id")
    return prints.join(named, prints.fp == named.node).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the near-duplicates: the rows of each group's smallest doc_id stay (rows that
    repeat that id too; where a whole group has a null doc_id, its rows stay)."""
    kept = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("row_id"))
    return rows.join(kept, F.expr("row_id <=> kept_id"), "left_semi").select("row.*")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
