"""Deleted-interpolation language model: n-gram estimates mixed by context-frequency buckets.

Counts are never broadcast. Documents are cut into chunks of bounded size; a chunk asks for the counts of
its distinct n-grams once, as sorted hash deltas dealt by hash range, and gets them back in the same order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Bytes of text of a chunk, and of the text whose n-grams meet in one hash range; the least number of ranges.
CHUNK, RANGE, MIN_RANGES = 6 << 20, 12 << 20, 64
HELD_OUT, FOLD, MODULUS = 2, 3, 7
#: The histogram for expectation-maximisation: log2 of a component from 1 downward, in steps of at least so much.
STEP, LEVELS = 0.25, 128
#: Buckets of context frequency: log2 of the count, the last open.
BUCKETS = 24
END, START = b" end", b" start"  # no word holds a space


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes under zstd: high planes of small numbers cost nothing."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def remainder(doc_id: int | None) -> int:
    """crc32 of the id's text (null: empty) modulo ``MODULUS``."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of a pair of 64-bit hashes, the low byte cleared: 56 bits tell n-grams apart."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & ~np.uint64(255)


class Chunk:
    """Tokens of some whole documents: word numbers, each number's hash, document lengths and ids."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        end, _ = number[END], number[START]
        words: list[int] = []
        self.lengths = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            at = len(words)
            words.extend(map(number.__getitem__, (text or "").encode().lower().split()))
            words.append(end)
            self.lengths[i] = len(words) - at
        self.ids, self.words = ids, np.array(words, dtype=np.uint32)
        self.hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, number)), dtype=">u8").astype(np.uint64)
        self.part = np.array([remainder(x) for x in ids], dtype=np.int64)
        self.key = xxhash.xxh64_intdigest(repr((ids, self.lengths.tolist())).encode() + self.words.tobytes()) >> 1

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its hash, its bigram's hash, its document's part."""
        token = self.hashes[self.words]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.cumsum(self.lengths)[:-1]] = self.hashes[1]
        before[:1] = self.hashes[1]
        return token, _mix(before, token), np.repeat(self.part, self.lengths)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Chunk]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # a whole batch as Python strings would double its memory
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(doc)
                texts.append(text)
                size += len(text or "") + 16
                if size >= limit:
                    yield Chunk(ids, texts)
                    ids, texts, size = [], [], 0
    if ids:
        yield Chunk(ids, texts)


def _counted(hashes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, with how often they occur in training documents and in the fold."""
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    cut = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    p = part[order]
    return run[cut], np.add.reduceat(p != HELD_OUT, cut, dtype=np.uint32), np.add.reduceat(p == FOLD, cut, dtype=np.uint32)


def _requests(batches: Iterator[pa.RecordBatch], limit: int, bits: int) -> Iterator[pa.RecordBatch]:
    names = ["range", "chunk", "kind", "hashes", "train", "fold"]
    shift = np.uint64(64 - bits)
    for chunk in _chunks(batches, limit):
        token, pair, part = chunk.grams()
        rows = []
        for kind, hashes in ((1, token), (2, pair)):
            distinct, train, fold = _counted(hashes, part)
            at = np.searchsorted(distinct >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
            for r, (a, b) in enumerate(zip(at, at[1:])):
                if b > a:
                    rows.append((r, chunk.key, kind, pack_sorted(distinct[a:b]), pack(train[a:b]), pack(fold[a:b])))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


_ANSWERS = "range int, chunk long, kind int, train binary, fold binary, total long, fold_total long, n_distinct long, fold_distinct long"


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums the counts of one hash range and one order over all chunks, and answers each chunk in its own order."""
    asked = [unpack_sorted(x) for x in rows["hashes"].to_pylist()]
    lengths = np.array([len(x) for x in asked])
    distinct, where = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    sums = [np.zeros(len(distinct), dtype=np.int64) for _ in range(2)]
    ends = np.cumsum(lengths)
    for total, column in zip(sums, ("train", "fold")):
        for data, a, b in zip(rows[column].to_pylist(), ends - lengths, ends):
            total[where[a:b]] += unpack(data, np.uint32)  # distinct within a chunk
    train, fold = (s.astype(np.uint64) for s in sums)
    out = {"chunk": rows["chunk"].to_pylist() + [None], "train": [pack(train[where[a:b]]) for a, b in zip(ends - lengths, ends)] + [None],
           "fold": [pack(fold[where[a:b]]) for a, b in zip(ends - lengths, ends)] + [None]}
    n, rest = len(lengths), sums[0] - sums[1]
    stats = [int(sums[0].sum()), int(sums[1].sum()), int((sums[0] > 0).sum()), int((rest > 0).sum())]
    return pa.table(
        [pa.array([int(key[0].as_py())] * (n + 1), pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array([int(key[1].as_py())] * (n + 1), pa.int32()),
         pa.array(out["train"], pa.binary()), pa.array(out["fold"], pa.binary()), *[pa.array([None] * n + [s], pa.int64()) for s in stats]],
        names=[x.split()[0] for x in _ANSWERS.split(", ")])


_JOINED = "chunk long, ids binary, nulls binary, lengths binary, part binary, c1 binary, c2 binary, ctx binary, f1 binary, f2 binary, fctx binary"


def _sequences(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches, limit):
        ids = np.array([-1 if x is None else x for x in c.ids], dtype=np.int64)
        nulls = np.array([x is None for x in c.ids], dtype=np.uint8)
        row = [c.key, pack(ids), pack(nulls), pack(c.lengths), pack(c.part), pack(c.words), pack(c.hashes)]
        kinds = [pa.int64()] + [pa.binary()] * 6
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["chunk", "ids", "nulls", "lengths", "part", "words", "hashes"])


def _join(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Per token of a chunk: counts of the token, its bigram and its context, in training and in the fold."""
    names = [x.split()[0] for x in _JOINED.split(", ")]
    rows: list[list] = []
    if docs.num_rows:
        # equal chunks (equal ids and texts) share a key and have equal answers
        given = {(x["kind"], x["range"]): x for x in answers.to_pylist()}
        counts = {
            (k, name): np.concatenate([np.empty(0, np.uint64), *[unpack(given[at][name], np.uint64) for at in sorted(given) if at[0] == k]])
            for k in (1, 2) for name in ("train", "fold")}
        for x in docs.to_pylist():
            c = Chunk.__new__(Chunk)
            c.words, c.hashes, c.lengths, c.part = unpack(x["words"], np.uint32), unpack(x["hashes"], np.uint64), unpack(x["lengths"], np.int64), unpack(x["part"], np.int64)
            token, pair, part = c.grams()
            first = np.r_[0, np.cumsum(c.lengths)[:-1]]
            places = {}
            for k, hashes in ((1, token), (2, pair)):
                distinct, at = np.unique(hashes, return_inverse=True)
                if len(distinct) != len(counts[k, "train"]):
                    raise RuntimeError("a chunk's documents changed between two reads")
                places[k] = at
            found = {}
            for name in ("train", "fold"):
                one, two = counts[1, name][places[1]], counts[2, name][places[2]]
                ctx = np.empty_like(one)
                ctx[1:] = one[:-1]
                ctx[first] = 0  # the start's count is that of the documents, put in when scoring
                found[name] = (one, two, ctx)
            heart = part == FOLD
            rows.append([x["chunk"], x["ids"], x["nulls"], x["lengths"], x["part"], *map(pack, found["train"]), *[pack(v[heart]) for v in found["fold"]]])
    kinds = [pa.int64()] + [pa.binary()] * 10
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 11, kinds)], names=names)


def _bucket(ctx: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then 1 + floor(log2(count)), the last open."""
    return np.minimum(np.where(ctx > 0, 1 + np.log2(np.maximum(ctx, 1)), 0).astype(np.int64), BUCKETS - 1)


def _components(c1: np.ndarray, c2: np.ndarray, ctx: np.ndarray, n: int, v: int) -> np.ndarray:
    """Rows: uniform, unigram and bigram maximum-likelihood probabilities."""
    p1 = c1 / max(n, 1)
    p2 = np.where(ctx > 0, c2 / np.maximum(ctx, 1), 0.0)
    return np.stack([np.full(len(p1), 1 / (v + 1)), p1, p2])


def _with_start(ctx: np.ndarray, lengths: np.ndarray, starts: int) -> np.ndarray:
    ctx = ctx.astype(np.float64)
    ctx[np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)] = starts
    return ctx


def _step(n: int) -> float:
    """The step with which the levels reach from 1 down to 1 / n, the least probability of a word that ``n`` tokens hold."""
    return max(STEP, float(np.log2(max(n, 2))) / (LEVELS - 2))


def _level(p: np.ndarray, step: float) -> np.ndarray:
    """0 for probability zero, else the rounded log, shifted so that probability 1 has the last level."""
    with np.errstate(divide="ignore"):
        q = np.rint(np.log2(p) / step) + LEVELS - 1
    return np.where(p > 0, np.clip(q, 1, LEVELS - 1), 0).astype(np.int64)


def learn_weights(joined: DataFrame, stats: dict, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bucket, component), by expectation-maximisation on held-out counts.

    The held-out documents are one fold of the training documents; their tokens' components come from the counts of the other folds. All
    the fold's tokens enter a histogram of (bucket, component levels), summed on the executors: at most
    BUCKETS * LEVELS**2 cells reach the driver, however large the input.
    """
    n, v, starts = stats["n"] - stats["fold_n"], stats["rest_v"], stats["starts"] - stats["fold_starts"]
    step = _step(max(n, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                lengths, part = unpack(x["lengths"], np.int64), unpack(x["part"], np.int64)
                heart = np.repeat(part, lengths) == FOLD
                if not heart.any():
                    continue
                own = lengths[part == FOLD]
                c1, c2, ctx = (unpack(x[a], np.uint64)[heart] - unpack(x[b], np.uint64) for a, b in (("c1", "f1"), ("c2", "f2"), ("ctx", "fctx")))
                ctx = _with_start(ctx, own, starts)
                p = _components(c1.astype(float), c2.astype(float), ctx, n, v)
                cell = (_bucket(ctx) * LEVELS + _level(p[1], step)) * LEVELS + _level(p[2], step)
                cells, times = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times.astype(np.int64))], names=["cell", "n"])

    hist = joined.select("lengths", "part", "c1", "c2", "ctx", "f1", "f2", "fctx").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return em(hist, 1 / (v + 1), step, rounds)


def em(hist: pd.DataFrame, uniform: float, step: float, rounds: int = 60) -> np.ndarray:
    cell, n = hist["cell"].to_numpy(dtype=np.int64), hist["n"].to_numpy(dtype=np.float64)
    bucket, levels = cell // (LEVELS * LEVELS), np.stack([cell // LEVELS % LEVELS, cell % LEVELS])
    p = np.vstack([np.full(len(cell), uniform), np.where(levels > 0, 2.0 ** ((levels - LEVELS + 1) * step), 0.0)])
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]  # an unseen context has no bigram estimate
    for _ in range(rounds):
        share = weights[bucket].T * p
        share *= n / np.maximum(share.sum(axis=0), 1e-300)
        sums = np.stack([np.bincount(bucket, s, BUCKETS) for s in share], axis=1)
        seen = sums.sum(axis=1) > 0
        weights[seen] = (sums[seen] + [1e-3, 0, 0]) / (sums[seen].sum(axis=1, keepdims=True) + 1e-3)
    return weights


def score_documents(docs: DataFrame, chunk_bytes: int = CHUNK, range_bytes: int = RANGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Null and empty texts hold one token, the end. Repeated rows count as often as they occur. With no training
    document every count is zero and all scores come from the uniform component. A word of every document is one entry per
    chunk, so no key is hot; memory is bounded by a chunk and by a hash range. Words are told apart by 64 hash bits, bigrams by 56.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    bits = max(MIN_RANGES, -(-size // range_bytes) - 1).bit_length()
    bits = bits - 1 if 1 << bits - 1 >= max(MIN_RANGES, size / range_bytes) else bits
    asked = slim.mapInArrow(lambda b: _requests(b, chunk_bytes, bits), "range int, chunk long, kind int, hashes binary, train binary, fold binary")
    answers = stage(asked.groupBy("range", "kind").applyInArrow(_answer, _ANSWERS), "counts")
    total = answers.where("chunk IS NULL AND kind = 1").agg(F.sum("total"), F.sum("fold_total"), F.sum("n_distinct"), F.sum("fold_distinct")).first()
    part = slim.select(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)).alias("r"))
    docs_n = part.agg(F.count_if(F.col("r") != HELD_OUT), F.count_if(F.col("r") == FOLD)).first()
    stats = dict(zip(("n", "fold_n", "v", "rest_v", "starts", "fold_starts"), [x or 0 for x in (*total, *docs_n)]))

    seq = slim.mapInArrow(lambda b: _sequences(b, chunk_bytes), "chunk long, ids binary, nulls binary, lengths binary, part binary, words binary, hashes binary")
    given = answers.where("chunk IS NOT NULL").select("range", "chunk", "kind", "train", "fold")
    joined = stage(seq.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(_join, _JOINED), "joined")
    weights = learn_weights(joined, stats) if stats["n"] else np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    n, v, starts = stats["n"], stats["v"], stats["starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                lengths, part = unpack(x["lengths"], np.int64), unpack(x["part"], np.int64)
                first = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
                c1, c2, ctx = (unpack(x[a], np.uint64) for a in ("c1", "c2", "ctx"))
                ctx = _with_start(ctx, lengths, starts)
                p = _components(c1.astype(float), c2.astype(float), ctx, n, v)
                mixed = (weights[_bucket(ctx)].T * p).sum(axis=0)
                ids = pa.array(unpack(x["ids"], np.int64), mask=unpack(x["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(part == HELD_OUT), pa.array(lengths), pa.array(np.add.reduceat(c1 > 0, first, dtype=np.int64)), pa.array(np.full(len(lengths), n, dtype=np.int64)),
                     pa.array(np.add.reduceat(np.log10((c1.astype(float) + 1) / (n + v + 1)), first)), pa.array(np.add.reduceat(np.log10(mixed), first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.select("ids", "nulls", "lengths", "part", "c1", "c2", "ctx").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
