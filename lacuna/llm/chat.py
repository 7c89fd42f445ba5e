"""Chat formatting: a dialogue from every participant's view, with loss masks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ASSISTANT, USER, END = "<|assistant|>\n", "<|user|>", "<|end|>\n"
#: Turns of a conversation whose offsets are summed in one task.
BLOCK = 64


def escaped(text: Column) -> Column:
    """A backslash goes between ``<`` and a bar or backslash, so that no text holds a mark; taking it out again gives the text."""
    return F.regexp_replace(text, r"<([|\\])", r"<\\$1")


def header(speaker: Column, view: Column) -> Column:
    """The viewer's own turns are the assistant's; all others are users under their names."""
    return F.when(speaker.eqNullSafe(view), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), escaped(F.regexp_replace(F.coalesce(speaker, F.lit("unknown")), r"[\r\n]+", " ")), F.lit("\n")))


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, view, position, speaker, is_assistant, start, mask_start, mask_end, end, segment)``: one row per
    participant and turn.

    ``segment`` is the turn as ``view`` sees it: header, text, end mark; the segments in order of
    ``position`` are the rendered dialogue, and code points [mask_start, mask_end) of it carry loss: the viewer's own
    words and end marks, nothing of others (there the two are equal).

    Marks inside a turn's text, or a speaker's name, are escaped (see ``escaped``), and line breaks of a name are blanks: no turn can forge another.

    Turns are ordered by number, then speaker, then text (nulls first); equal rows stay, in any order among themselves. A null
    role is a participant, called unknown; a null text is empty. Conversations are never gathered in one row: offsets come from
    sums within blocks of turn numbers and then over blocks, so a conversation with a third of all rows is
    spread over tasks.
    """
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("speaker"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    views = t.select(F.col("conv_id").alias("c2"), F.col("speaker").alias("view")).distinct()
    seen = t.join(views, F.col("conv_id").eqNullSafe(F.col("c2"))).drop("c2")
    segment = F.concat(header(F.col("speaker"), F.col("view")), F.col("text"), F.lit(END))
    rows = seen.select(
        "conv_id", "view", "turn", "speaker", "text", F.floor(F.col("turn") / F.lit(block)).cast("long").alias("block"),
        F.length(segment).cast("long").alias("n"), F.length(header(F.col("speaker"), F.col("view"))).cast("long").alias("n_head"))
    key = ["conv_id", "view", "block"]
    sums = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("conv_id", "view").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"b_{c}") for c in key], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"))
    inside = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("n1", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("k1", F.count(F.lit(1)).over(inside))
    joined = local.join(base, F.expr(" AND ".join(f"{c} <=> b_{c}" for c in key)))
    start = F.col("n0") + F.col("n1")
    own = F.col("speaker").eqNullSafe(F.col("view"))
    return joined.select(
        "conv_id", F.coalesce("view", F.lit("unknown")).alias("view"), (F.col("k0") + F.col("k1")).alias("position"), F.coalesce("speaker", F.lit("unknown")).alias("speaker"),
        own.alias("is_assistant"), start.alias("start"), (start + F.when(own, F.col("n_head")).otherwise(F.col("n"))).alias("mask_start"), (start + F.col("n")).alias("mask_end"),
        (start + F.col("n")).alias("end"), F.concat(header(F.col("speaker"), F.col("view")), F.col("text"), F.lit(END)).alias("segment"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


def oracle_chat_rotation() -> str:
    def mark(x: str) -> str:
        return rf"regexp_replace({x}, '<([|\\])', '<\\\1', 'g')"

    empty, name = "coalesce(text, '')", r"regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g')"
    return f"""
WITH t AS (SELECT conv_id, turn, role, {mark(empty)} AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, role AS view FROM t),
s AS (SELECT t.*, v.view, CASE WHEN role IS NOT DISTINCT FROM view THEN '{ASSISTANT}' ELSE '{USER}' || {mark(name)} || chr(10) END AS head
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
r AS (SELECT *, head || text || '{END}' AS segment FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, view
        ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM r WINDOW w AS (PARTITION BY conv_id, view ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, coalesce(view, 'unknown') AS view, position, coalesce(role, 'unknown') AS speaker, role IS NOT DISTINCT FROM view AS is_assistant, start,
  (start + CASE WHEN role IS NOT DISTINCT FROM view THEN length(head) ELSE length(segment) END)::BIGINT AS mask_start,
  (start + length(segment))::BIGINT AS mask_end, (start + length(segment))::BIGINT AS "end", segment
FROM o"""
