"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .tokens import token_ids

LENGTH, END = 1024, 2
#: Items of a shard, islands of a shard, individuals of an island, generations of an epoch, epochs.
SHARD, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 8192, 2, 4, 3, 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each whole document: ids of its text, then ``end``.

    Only documents of more than ``length`` ids are cut: the first piece takes the odd rest, all
    others are full. A null text counts as empty (one piece: the end id); repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", path), np.uint32(end)).astype("<u4")
                cut = len(ids) % length if len(ids) > length else len(ids)
                starts = [0, *range(cut, len(ids), length)] if cut else list(range(0, len(ids), length))
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


class Bins:
    """Open bins by free room: the tightest that fits is found by one shift of a bit mask."""

    def __init__(self, capacity: int, bins: list[list[int]], sizes: list[int]):
        self.capacity, self.sizes, self.bins = capacity, sizes, bins
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0
        for b, items in enumerate(bins):
            self._open(b, capacity - sum(sizes[i] for i in items))

    def _open(self, b: int, room: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def add(self, item: int) -> None:
        """Best fit: into the fullest bin with room for the item, else into a new one."""
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.bins.append([item])
            self._open(len(self.bins) - 1, self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        stack = self.by_room[room]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        self.bins[b].append(item)
        self._open(b, room - size)


def best_fit(sizes: list[int], order: list[int], capacity: int, start: list[list[int]] | None = None) -> list[list[int]]:
    packed = Bins(capacity, [list(x) for x in start or []], sizes)
    for item in order:
        packed.add(item)
    return packed.bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewest bins first, then the most uneven filling (mean squared fill), to be maximised."""
    fills = [sum(sizes[i] for i in b) / capacity for b in bins]
    return -len(bins), sum(f * f for f in fills) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Injects the well-filled bins of ``b`` whole into ``a``; bins of ``a`` that hold an item twice now
    go; their other items are displaced and best-fitted, largest first."""
    full = [x for x in b if sum(sizes[i] for i in x) >= capacity - 1]
    given = rng.sample(full, max(1, len(full) // 4)) if full else [max(b, key=lambda x: sum(sizes[i] for i in x))]
    taken = {i for x in given for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, kept + given)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties the loosest bins and some others, and best-fits their items again, largest first."""
    if len(bins) < 3:
        return bins
    order = sorted(range(len(bins)), key=lambda b: sum(sizes[i] for i in bins[b]))
    loose = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 20)))
    items = sorted((i for b in loose for i in bins[b]), key=lambda i: -sizes[i])
    return best_fit(sizes, items, capacity, [x for b, x in enumerate(bins) if b not in loose])


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], generations: int, rng: random.Random) -> list[list[list[int]]]:
    """The population after some generations; stops early at the lower bound on bins."""
    bound = -(-sum(sizes) // capacity)
    rank = lambda p: sorted(p, key=lambda x: fitness(x, sizes, capacity), reverse=True)
    population = rank(population)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        mother, father = population[0], rng.choice(population[1:] or population)
        child = mutate(crossover(mother, father, sizes, capacity, rng), sizes, capacity, rng)
        population = rank([*population[: max(1, len(population) - 1)], child])
    return population


def seeds(sizes: list[int], capacity: int, n: int, rng: random.Random) -> list[list[list[int]]]:
    """Best fit in decreasing order, and in orders slightly shaken from it."""
    out = []
    for k in range(n):
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + 0.05 * k * rng.random()))
        out.append(best_fit(sizes, order, capacity))
    return out


def _encode(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _decode(codes: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(codes.max()) + 1 if len(codes) else 0)]
    for i, b in enumerate(codes.tolist()):
        bins[b].append(i)
    return bins


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    """One island's epoch as a grouped pandas function."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        sizes = frame["length"].tolist()
        rng = random.Random(f"{key[0]}.{key[1]}.{epoch}")
        given = [_decode(frame[c].to_numpy(dtype=np.int64)) for c in ("elite", "guest") if frame[c].notna().all()]
        best = evolve(sizes, capacity, given + seeds(sizes, capacity, population - len(given), rng), generations, rng)[0]
        frame["elite"] = _encode(best, len(sizes))
        frame["score"] = fitness(best, sizes, capacity)[1] - len(best)
        return frame[["shard", "row", "length", "island", "elite", "score"]]

    return run


def islands(items: DataFrame, capacity: int, n_islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS) -> DataFrame:
    """``(shard, row, bin)`` from ``(shard, row, length)``: each shard's items packed by islands that exchange elites.

    An epoch runs every (shard, island) as a task of its own; then each island's elite is written
    to the shared folder and its ring neighbour starts the next epoch with it. A shard's size is bounded, so
    one task holds at most a shard's lengths. Seeded by shard, island and epoch: a lost
    task's rerun gives the same bins.
    """
    isl = F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1))).alias("island")
    now = items.select("shard", "row", "length", isl).withColumn("elite", F.lit(None).cast("int")).withColumn("guest", F.lit(None).cast("int"))
    for epoch in range(epochs):
        run = _epoch(capacity, population, generations, epoch)
        done = stage(now.groupBy("shard", "island").applyInPandas(run, "shard long, row long, length int, island int, elite int, score double"), f"epoch-{epoch}")
        if epoch + 1 < epochs:
            guest = done.select("shard", "row", ((F.col("island") + 1) % n_islands).cast("int").alias("island"), F.col("elite").alias("guest"))
            now = done.select("shard", "row", "length", "island", "elite").join(guest, ["shard", "row", "island"])
    best = done.groupBy("shard").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("island"))
    return done.join(best, ["shard", "island"]).select("shard", "row", F.col("elite").alias("bin"))


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and gapless ``offset``.

    Full pieces are sequences by themselves. All others are dealt evenly, by a hash of the row, into shards of
    about ``shard`` items and packed by the islands. Each shard's loosest bins are then packed
    once more, many shards' together. Any number of equal ids or texts only adds
    items; an empty table gives no rows. Peak memory of a task: one shard's lengths and a few packings.
    """
    found = stage(pieces(docs, length, end, path, id_col, text_col), "pieces")
    rows = stage(found.withColumn("row", F.monotonically_increasing_id()), "rows")
    part = rows.where(F.col("length") < length).select("row", F.col("length").cast("int").alias("length"))
    n = part.count()
    shards = max(1, -(-n // shard))
    items = part.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    first = islands(items, length).join(items.select("row", "length"), "row")
    placed = stage(first, "first")
    fill = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("items"))
    loose = fill.where(F.col("fill") < length - length // 16).select("shard", "bin")
    again = placed.join(loose, ["shard", "bin"], "left_semi").select("row", "length", F.floor(F.col("shard") / F.lit(64)).cast("long").alias("shard"))
    second = islands(again, length, n_islands=1, epochs=1)
    kept = placed.join(loose, ["shard", "bin"], "left_anti").select("row", F.struct(F.lit(0).alias("level"), "shard", "bin").alias("place"))
    moved = second.select("row", F.struct(F.lit(1).alias("level"), "shard", "bin").alias("place"))
    place = kept.unionAll(moved)
    top = (F.col("place.level").cast("long") * (1 << 62)) + F.col("place.shard") * (1 << 24) + F.col("place.bin")
    named = rows.join(place.select(F.col("row"), top.alias("sequence_id")), "row", "left").withColumn(
        "sequence_id", F.coalesce("sequence_id", F.lit(1 << 61) + F.col("row") % (1 << 61)))
    from pyspark.sql import Window

    inside = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return named.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
