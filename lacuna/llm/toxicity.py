"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window lengths compared.

Words are spelled in codes of 16 hash bytes before they are compressed: zstandard pays some four bytes a match, so
in plain spelling a short word gains nothing from standing in a dictionary (held-out AUC 0.7 at best, 0.99 with codes).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Words of a window; bytes of a word's code; words of a dictionary: those both classes use often, and those of its own class.
WINDOW, CODE, SHARED, OWN = 8, 16, 3072, 4096
#: Labelled texts of each class that fit the model, about (chosen by a hash of their ids), and folds of them that calibrate it.
DOCS, FOLDS = 4096, 3
#: A held-out row's remainder and modulus.
HELD_OUT, MODULUS = 0, 5
#: Bytes a window must save to count, of which the calibration chooses one.
THRESHOLDS = (4, 8, 11, 16, 22)
#: Codes that a worker remembers; texts of a batch that are compressed together; characters from which a text's words are read one by one.
REMEMBERED, SLICE, LONG = 200_000, 256, 1 << 20
_WORD = re.compile(r"\w+")
_FILL = xxhash.xxh3_128_digest(b"\0")


class Codes(dict):
    """Word to code, computed once a word; emptied when it grows."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_128_digest(word.encode("utf-8", "surrogatepass"))
        return code


def distinct_words(text: str | None) -> list[str]:
    """The text's different words (runs of word characters, lower-case) in the order of their first places."""
    low = (text or "").lower()
    if len(low) < LONG:
        return list(dict.fromkeys(_WORD.findall(low)))
    return list(dict.fromkeys(m.group() for m in _WORD.finditer(low)))


def windows(words: Iterable[str], codes: Codes) -> list[bytes]:
    """Codes of ``WINDOW`` words each; the last is filled up, and a text without words is one window of filling."""
    it, out = map(codes.__getitem__, words), []
    while part := list(islice(it, WINDOW)):
        out.append(b"".join(part).ljust(WINDOW * CODE, b"\0"))
    return out or [_FILL * WINDOW]


def _parameters() -> zs.ZstdCompressionParameters:
    return zs.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=3, min_match=7, strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)


def compressor(dictionary: bytes) -> zs.ZstdCompressor:
    made = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=_parameters())
    return zs.ZstdCompressor(compression_params=_parameters(), dict_data=made)


def lengths(by: zs.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    found = by.multi_compress_to_buffer(parts, threads=1)
    return np.fromiter(map(len, map(found.__getitem__, range(len(found)))), np.int32, len(found))


def dictionary(shared: list[str], own: list[str]) -> bytes:
    """Codes of a class's own words, rarest first, then of the shared words; both classes' dictionaries have the same size and shared part,
    so a word that isn't the mark of one class costs the same in both."""
    codes = Codes()
    return b"".join(codes[w] for w in own[:OWN][::-1]).rjust(OWN * CODE, b"\0") + b"".join(codes[w] for w in shared[::-1])


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the bytes a window must save to count, and weights of (1, log(1 + hits), log(windows), hits / windows)."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {k: v if k != "_made" else {} for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)

    def savings(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the toxic dictionary saves, number of the text) of every window."""
        if not self._made:
            self._made.update(o=compressor(self.ordinary), t=compressor(self.toxic), codes=Codes())
        parts, at = [], []
        for i, text in enumerate(texts):
            w = windows(distinct_words(text), self._made["codes"])
            parts += w
            at += [i] * len(w)
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return lengths(self._made["o"], parts) - lengths(self._made["t"], parts), np.array(at)

    def counts(self, texts: list[str | None], threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows that save ``threshold`` bytes or more, windows) of every text."""
        saved, at = self.savings(texts)
        return np.bincount(at, saved >= threshold, len(texts)), np.bincount(at, minlength=len(texts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hits, n = self.counts(texts, self.threshold)
        return sigmoid(design(hits, n) @ np.array(self.weights))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def design(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.column_stack([np.ones(len(n)), np.log1p(hits), np.log(n), hits / n])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, and the loss."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ b)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        b += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(sigmoid(x @ b), 1e-12, 1 - 1e-12)
    return b, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def _remainder(id_col: str):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % MODULUS


def training_sample(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS) -> tuple[DataFrame, dict[int, int]]:
    """``(toxic, fold, text)`` of about ``docs_per_class`` labelled texts of each class outside the held-out rows, and the classes' label counts.

    Ids are chosen by hash, so a rerun takes the same ones; equal texts of a class count once. An id with several labels counts as
    toxic if one says so; null labels and null ids are left out. The chosen ids are few by construction, so they are broadcast.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IS NOT NULL").where(_remainder("id") != HELD_OUT).groupBy("id").agg(F.max("toxic").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in totals.items():
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, docs_per_class / n))).otherwise(share)
    chosen = marks.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "id").select("toxic", "text").distinct()
    return sample.select("toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text"), totals


def word_counts(sample: DataFrame) -> DataFrame:
    """``(word, c00, c01, ...)``: texts of class c and fold f that hold the word, as ``c{c}{f}``; words in under three texts are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), SLICE):
                part = f.iloc[at : at + SLICE]
                words = [(c, k, w) for c, k, t in zip(part["toxic"], part["fold"], part["text"]) for w in distinct_words(t)]
                yield pd.DataFrame(words, columns=["toxic", "fold", "word"]).groupby(["toxic", "fold", "word"], as_index=False).size().rename(columns={"size": "n"})

    counted = sample.mapInPandas(run, "toxic int, fold int, word string, n long")
    cells = [F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == k), F.col("n"))), F.lit(0)).alias(f"c{c}{k}") for c in (0, 1) for k in range(FOLDS)]
    return counted.groupBy("word").agg(*cells, F.sum("n").alias("n")).where("n > 2")


def _marked(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None) -> tuple[list[str], list[str]]:
    """The words that one class uses far more often than the other: of ordinary, then of toxic text. ``without``: a fold left out.

    A word marks a class if at least 8 times as frequent there, and in more of its texts than chance gives by four deviations.
    """
    folds = [k for k in range(FOLDS) if k != without]
    n = [max(1, sum(sizes.get((c, k), 0) for k in folds)) for c in (0, 1)]
    here = [sum((F.col(f"c{c}{k}") for k in folds), F.lit(0)) for c in (0, 1)]
    found = []
    for c in (0, 1):
        chance = (here[1 - c] + 1) * (n[c] / n[1 - c])
        marks = counts.where((here[c] >= 8 * chance) | (here[c] == n[c])).where(here[c] >= 2 + chance + 4 * F.sqrt(chance))
        found.append([r["word"] for r in marks.select("word", here[c].alias("k")).orderBy(F.desc("k"), "word").limit(OWN).collect()])
    return found[0], found[1]


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS) -> Model:
    """Dictionaries from the labelled texts' words, threshold and weights from folds that a dictionary hasn't seen.

    Only labels of rows outside the held-out ones are read, and only texts are inputs. The sample is bounded by ``docs_per_class``; its texts stay in
    Spark, and the driver gets the dictionaries' words and four numbers a sampled text. With labels of one class or none, scores are that class's share.
    """
    spark = docs.sparkSession
    sample, totals = training_sample(docs, labels, docs_per_class)
    sample = stage(sample, "toxicity_sample")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({c for c, _ in sizes}) < 2:
        share = 1.0 if totals and not totals.get(0) else 0.0
        return Model(dictionary([], []), dictionary([], []), THRESHOLDS[0], (8.0 if share else -8.0, 0.0, 0.0, 0.0))
    counts = stage(word_counts(sample), "toxicity_words")
    shared = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(SHARED).collect()]
    models = []
    for without in (*range(FOLDS), None):
        own = _marked(counts, sizes, without)
        apart = {*own[0], *own[1]}
        both = [w for w in shared if w not in apart]
        models.append(Model(dictionary(both, own[0]), dictionary(both, own[1]), 0, ()))
    seen = spark.sparkContext.broadcast(models[:FOLDS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (c, k), rows in f.groupby(["toxic", "fold"]):
                for at in range(0, len(rows), SLICE):
                    texts = rows["text"].iloc[at : at + SLICE].tolist()
                    saved, where = seen.value[k].savings(texts)
                    out = {f"h{t}": np.bincount(where, saved >= t, len(texts)).astype(float) for t in THRESHOLDS}
                    yield pd.DataFrame({"toxic": int(c), "n": np.bincount(where, minlength=len(texts)).astype(float), **out})

    schema = "toxic int, n double, " + ", ".join(f"h{t} double" for t in THRESHOLDS)
    found = sample.mapInPandas(run, schema).toPandas().sort_values(["toxic", "n", *[f"h{t}" for t in THRESHOLDS]])
    y = found["toxic"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    weight *= len(y) / weight.sum()
    best = min(((*logistic(design(found[f"h{t}"].to_numpy(), found["n"].to_numpy()), y, weight), t) for t in THRESHOLDS), key=lambda r: r[1])
    return Model(models[-1].ordinary, models[-1].toxic, best[2], tuple(map(float, best[0])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, hits, windows, score)``: each whole text's windows that the toxic dictionary shortens, all windows, and the calibrated score.

    One narrow pass. Null and empty texts are one window of filling; equal texts have equal scores; repeated rows and null ids stay; other
    columns are ignored, whatever their names; an empty table gives no rows. Memory is bounded by one slice of an Arrow batch, for a very
    long text by its different words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                hits, n = model.counts(part.column(1).to_pylist(), model.threshold)
                chance = sigmoid(design(hits, n) @ np.array(model.weights))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hits.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(chance)], names=["doc_id", "hits", "windows", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, hits long, windows long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labels that may be learnt, then score every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (_remainder("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "windows")
