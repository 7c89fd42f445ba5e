"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table, unit_hash

#: The hash has 60 bits; each refinement resolves ``BITS`` more of them.
HASH_BITS, BITS = 60, 12
#: Sources up to which the table of thresholds is broadcast; beyond, the same join shuffles.
SMALL = 1_000_000


def word_count(text) -> "F.Column":
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code-point order (null last) weigh 1, 2, .., ``cycle``, repeating, and share all
    tokens; a target stops at ``max_epochs`` times its source's size and the excess goes to the
    others by weight, until none is above. That fixed point is target = min(cap, level * weight):
    in order of cap / weight the capped sources come first, so two running sums find the level.
    The windows hold one row per source, never one per document.
    """
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("double"))
    cap = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first uncapped source in this order fixes the level for all after it
    fits = cap.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    final = fits.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return final.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def hash_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, source_size, target, epochs, below)``: how often each whole source is taken, and the hash
    below which a document is taken once more.

    The first histogram sums sizes by source and leading hash bits; running sums over at most
    2**BITS buckets a source find the bucket where the rest of the budget ends. Only that bucket's
    documents enter the next, finer histogram, until a bucket is one hash value; that
    last value is taken if it brings the source's total nearer to its target.
    """
    state = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    live = sized
    for depth in range(BITS, HASH_BITS + 1, BITS):
        width = 1 << (HASH_BITS - depth)
        hist = live.groupBy("source", F.shiftright("hash", HASH_BITS - depth).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = hist.withColumn("upto", F.sum("n").over(running))
        cut = (
            upto.alias("h").join(state.alias("s"), F.expr("h.source <=> s.source AND h.upto > s.rest"))
            .groupBy("s.source").agg(F.min(F.struct("bucket", "n", "upto")).alias("c"))
        )
        joined = state.alias("s").join(cut.alias("c"), F.expr("s.source <=> c.source"), "left")
        last = depth == HASH_BITS
        over = F.col("c.c.upto") - F.col("c.c.n")
        edge = F.col("c.c.bucket") * F.lit(width)
        # with no bucket beyond the budget all live documents are below the threshold
        at = F.when(F.col("c.c.bucket").isNull(), F.when(F.lit(depth == BITS), F.lit(1 << HASH_BITS)).otherwise(F.col("s.below") + F.lit(width << BITS)))
        if last:
            nearer = 2 * (F.col("s.rest") - over) >= F.col("c.c.n")
            at = at.otherwise(edge + F.when(nearer, F.lit(width)).otherwise(F.lit(0)))
        else:
            at = at.otherwise(edge)
        state = stage(joined.select(
            "s.source", "s.source_size", "s.target", "s.epochs",
            F.when(F.col("c.c.bucket").isNull(), F.col("s.rest")).otherwise(F.col("s.rest") - over).alias("rest"),
            at.cast("long").alias("below")), f"mix-{depth}")
        if not last:
            spot = state.select(F.col("source").alias("s2"), F.shiftright("below", HASH_BITS - depth).alias("b2"))
            live = live.join(spot, F.expr(f"source <=> s2 AND shiftright(hash, {HASH_BITS - depth}) = b2"), "left_semi")
    return state.select("source", "source_size", "target", "epochs", "below")


def _thresholds(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The staged sizes, and the thresholds (one row per source; broadcast behind a check of their number)."""
    sized = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), unit_hash(F.col(id_col)).alias("hash")), "sizes")
    marks = hash_thresholds(sized, source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    marks = marks.select(F.col("source").alias("mix_source"), "source_size", "target", "epochs", "below")
    return sized, F.broadcast(marks) if marks.count() <= SMALL else marks


def _copies(hash_col: str) -> "F.Column":
    return F.col("epochs") + F.when(F.col(hash_col) < F.col("below"), F.lit(1)).otherwise(F.lit(0))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, copies)``, one row per input row.

    The texts are read once; all histograms work on a narrow staged table of sizes. A source's
    documents are never sorted or gathered: a source holding a third of all rows only adds to the
    same at most 4096 partial sums. Documents with equal ids share a hash and are taken or left
    together; a null id hashes as an empty one; null and empty texts have size 0 and take 0; a
    null source is a source of its own, the last one; an empty table gives no rows.
    """
    sized, marks = _thresholds(docs, id_col, text_col, source_col)
    copies = _copies("hash").cast("long")
    return sized.join(marks, F.expr("source <=> mix_source")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them (0 to 3 times), with their columns unchanged.

    The verdict of a row depends on its source and its id's hash alone, so the texts meet
    only the thresholds, one row per source, and are not shuffled.
    """
    _, marks = _thresholds(docs, "doc_id", "text", "source")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("src"), unit_hash(F.col("doc_id")).alias("h"))
    taken = packed.join(marks, F.expr("src <=> mix_source")).select("row", _copies("h").cast("int").alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def oracle_mixing() -> str:
    """The same fixed point by an independent route: repeated resharing is unrolled as a recursion."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT 0 AS step, source, source_size, weight, cap, sum(source_size) OVER () * weight / sum(weight) OVER () AS target FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight, cap,
    CASE WHEN target >= cap THEN cap ELSE target + weight * (sum(greatest(target - cap, 0)) OVER ())
      / (sum(CASE WHEN target < cap THEN weight ELSE 0 END) OVER ()) END
  FROM r WHERE step < 60),
t AS (SELECT source, source_size, target FROM r WHERE step = 60),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
      sum(size) OVER (PARTITION BY source, hash) AS tied FROM e)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto <= rest OR 2 * (rest - (upto - tied)) >= tied THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM c"""
