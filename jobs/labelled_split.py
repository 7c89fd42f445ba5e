"""Labelled corpus with a stratified split: documents that have labels, dealt to train, validation and test by class.

    python -m jobs.labelled_split --documents IN --labels IN --output OUT --config jobs/labelled_split.json

``OUT/corpus`` holds the documents by split and language, ``OUT/report`` the counts and shares of every class as JSON. Where a document goes depends on the
digests of its class's texts alone, so a rerun over the same tables writes the same rows, and equal texts never stand on both sides of a split.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import gaps, prep

from .common import main

log = logging.getLogger("labelled_split")

CORPUS = "doc_id long, text string, source string, n_words long, class string, digest long, split string, lang string"


@dataclass(frozen=True)
class Settings:
    """Label columns whose values, with the language, name a class; the splits and their shares, which add up to 1; the words a text must have; rows of an output file."""

    label_columns: list[str] = field(default_factory=lambda: ["toxic"])
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "validation": 0.1, "test": 0.2})
    min_words: int = 1
    rows_per_file: int = 1_000_000


def labelled(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Documents with a whole label, and enough words, with their class.

    A document without a label, with a null among its labels, or with labels that contradict each other has no class and goes; repeated labels count once. The join is
    an equi-join on the id that adaptive execution may broadcast or split by size. A null language is its own class, ``none``.
    """
    names = settings.label_columns
    label = F.struct(*names)
    complete = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ["doc_id", *names]))
    one = complete.groupBy("doc_id").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo = _hi").select("doc_id", "_lo.*")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "source", F.coalesce("lang", F.lit("none")).alias("lang"), words.alias("n_words"))
    digest = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = texts.where(F.col("n_words") >= settings.min_words).join(one, "doc_id")
    name = F.concat_ws("/", "lang", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names])
    return rows.select("doc_id", "text", "source", "lang", "n_words", name.alias("class"), digest.alias("digest"))


def build(spark: SparkSession, documents: str, labels: str, output: str, settings: Settings = Settings()) -> dict[str, int]:
    """Write the split corpus and its report to ``output``; returns the counts that it logs."""
    if abs(sum(settings.shares.values()) - 1) > 1e-9:
        raise ValueError("the shares must add up to 1")
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    missing = gaps.null_counts(docs, ["doc_id", "text", "lang"]).collect()
    log.info("missing in %s: %s", documents, ", ".join(f"{r['column']} {r['n_null']}" for r in missing))
    rows = labelled(docs, marks, settings)
    # ranks need ids and classes only: the texts are not shuffled by class, but meet their split by digest and class once
    dealt = prep.split(rows.select("class", "digest").distinct(), settings.shares, ["class"], "digest") if len(settings.shares) > 1 else rows.select("class", "digest").distinct().withColumn("split", F.lit(next(iter(settings.shares))))
    corpus = rows.join(dealt, ["class", "digest"]).select(*[c.split()[0] for c in CORPUS.split(", ")])
    files = corpus.hint("rebalance", "split", "lang").write.mode("overwrite").partitionBy("split", "lang")
    files.option("maxRecordsPerFile", settings.rows_per_file).parquet(f"{output}/corpus")
    counts = {"read": docs.count(), "written": read_corpus(spark, output).count()}
    log.info("read %d documents of %s, wrote %d with labels of %s to %s/corpus", counts["read"], documents, counts["written"], labels, output)
    split = read_corpus(spark, output).groupBy("class", "split").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("digest").alias("texts"), F.sum("n_words").alias("words"))
    split.coalesce(1).write.mode("overwrite").json(f"{output}/report")
    for r in spark.read.json(f"{output}/report").orderBy("class", "split").limit(100).collect() if counts["written"] else []:
        log.info("%s %s: %d documents, %d texts, %d words", r["class"], r["split"], r["documents"], r["texts"], r["words"])
    return counts


def read_corpus(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(f"{output}/corpus")


if __name__ == "__main__":
    main("labelled_split", {"documents": "documents", "labels": "labels by doc_id", "output": "folder of the corpus and its report"}, build, Settings)
