"""Token counts of flat token files: vectorised separator search, stitched across blocks by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, staging_path, table
from .tokens import default_path, token_ids

#: End-of-document id of the 50k byte-level vocabulary; texts never yield it (``plain`` encoding).
SEPARATOR = 50256
#: Bytes of a scanned block (a multiple of every item size).
BLOCK = 4 << 20
DTYPE = "<u2"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, separator: int = SEPARATOR, dtype: str = DTYPE, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one flat file a partition into ``folder`` (a URI of shared storage): each whole text's ids, then ``separator``.

    Returns the staged manifest ``(file, ordinal, doc_id)``; the files themselves hold no index. A rerun task
    writes the same bytes to the same name, by way of a name of its own attempt. An id that ``dtype`` can't hold raises a ValueError.
    """
    most = np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name = f"tokens-{context.partitionId():06d}.bin"
        own = f"{root}/_{name}.{context.taskAttemptId()}"
        n = 0
        with system.open_output_stream(own) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    ids = np.append(token_ids(text or "", path, plain=True), np.uint32(separator))
                    if ids.max() > most:
                        raise ValueError(f"id {ids.max()} doesn't fit {dtype}: give a wider dtype")
                    out.write(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                n += batch.num_rows
        if n:
            system.move(own, f"{root}/{name}")
        else:
            system.delete_file(own)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(slim.mapInArrow(run, "file string, ordinal long, doc_id long"), "manifest")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, file, bytes)`` of the finished files, listed by Spark without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def scan_blocks(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """``(file, block, at, n_seps, head, tail, inner)`` of every block of every file.

    ``head``: tokens before the block's first separator (all, if it has none); ``tail``: tokens after its last one;
    ``inner``: lengths of the documents that lie between two separators of the block. One comparison over a
    block's ids finds them all; a task holds one block.
    """
    width = np.dtype(dtype).itemsize
    if block % width:
        raise ValueError("a block must hold whole ids")
    blocks = files.select("path", "file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / F.lit(block)) - 1, F.lit(0)).cast("long"))).alias("block"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.where("bytes > 0").repartition(n, "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, size, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, name = _filesystem(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with system.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(min(block, size - at * block) // width * width, at * block), dtype=dtype)
                hits = np.flatnonzero(ids == separator)
                head, tail = (int(hits[0]), len(ids) - 1 - int(hits[-1])) if len(hits) else (len(ids), len(ids))
                row = [file, at, len(hits), head, tail, (np.diff(hits) - 1).tolist()]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["file", "block", "n_seps", "head", "tail", "inner"])

    return dealt.mapInArrow(run, "file string, block long, n_seps long, head long, tail long, inner array<long>")


def document_lengths(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, n_tokens)``: lengths without separators, documents that cross blocks stitched.

    A prefix scan over each file's block summaries: separators so far number the documents; tokens since the last
    separator are carried into the block where the document ends. Tokens after a file's last separator are an
    unfinished document and counted as one more (if there are any).
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    era = F.count_if(F.col("n_seps") > 0).over(order.rowsBetween(Window.unboundedPreceding, 0))
    scan = blocks.select("file", "block", "n_seps", "head", "tail", era.alias("era"))
    # tokens open at a block's end: its tail and those of the blocks without separator since the last one that had one
    since = F.sum("tail").over(Window.partitionBy("file", "era").orderBy("block"))
    open_at_end = scan.select("file", "block", "n_seps", "head", since.alias("open"))
    carried = open_at_end.select(
        "file", "block", "n_seps", "head", "open", F.coalesce(F.lag("open").over(order), F.lit(0)).alias("carry"),
        F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("ordinal"), F.lead("block").over(order).isNull().alias("last"))
    first = carried.where("n_seps > 0").select("file", "ordinal", (F.col("carry") + F.col("head")).alias("n_tokens"))
    rest = carried.where("last AND open > 0").select("file", (F.col("ordinal") + F.col("n_seps")).alias("ordinal"), F.col("open").alias("n_tokens"))
    starts = carried.where("n_seps > 1").select("file", "block", "ordinal")
    inner = blocks.where("n_seps > 1").select("file", "block", F.posexplode("inner").alias("i", "n_tokens")).join(starts, ["file", "block"])
    return first.unionAll(rest).unionAll(inner.select("file", (F.col("ordinal") + 1 + F.col("i")).alias("ordinal"), "n_tokens"))


def token_counts(docs: DataFrame, folder: str | None = None, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """``(doc_id, file, ordinal, n_tokens)`` of every input row, by way of flat files.

    Null and empty texts have 0 tokens; equal rows are written as often as they occur; an empty table gives no rows. The separator
    can't come from a text: its string is encoded as ordinary text.
    """
    spark = docs.sparkSession
    folder = folder or staging_path(spark, "token-files")
    manifest = write_token_files(docs, folder, path=path or default_path())
    if manifest.isEmpty():
        return manifest.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("n_tokens"))
    blocks = stage(scan_blocks(token_files(spark, folder), block=block), "token-blocks")
    return manifest.join(document_lengths(blocks), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
