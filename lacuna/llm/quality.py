"""Quality rules as a bitmask ledger: measure once, store failure bits, decide later."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in ``words``."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measures(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text (null: that of an empty text)."""
    raw = (text or "").encode()
    words = raw.split()  # bytes.split() cuts at exactly the six ASCII white-space bytes
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return (
        len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
        len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, LETTERS)),
    )


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measures, integers only) is true. ``bit`` never changes."""

    bit: int
    name: str
    fails: str


#: Bits are append-only: a policy of an older version keeps its meaning.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "5 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "shouting", "10 * n_upper > 4 * n_letters AND n_letters > 0"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(6, "few_letters", "3 * n_letters < word_chars AND 2 * n_symbols > word_chars"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """Keeps a document with at most ``tolerance`` failed rules among those of ``mask``."""

    name: str
    version: int
    mask: int
    tolerance: int = 0


POLICIES = (
    Policy("base", 1, 0b0000011),
    Policy("web", 1, 0b0001111),
    Policy("web", 2, 0b1111111),
    Policy("lenient", 1, 0b1111111, tolerance=1),
)
PRODUCTION = POLICIES[2]


def evaluate_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: ``(doc_id, *MEASURES, fail_bits)``, every rule evaluated once per document.

    One narrow pass with no shuffle, so no key can be hot. Null and empty texts measure zero
    (and fail ``few_words``); equal texts get equal rows; repeated rows stay repeated; any other
    columns are ignored, whatever their names; an empty table gives an empty ledger. Memory is
    bounded by one Arrow batch.
    """
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need distinct bits from 0 to 62")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(measures(x) for x in batch.column(1).to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in rows)], names=["doc_id", *MEASURES])

    measured = slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: Policy = PRODUCTION, out: str = "kept") -> DataFrame:
    """Adds the verdict of one versioned policy; reads only ``fail_bits``, never the texts."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    return ledger.withColumn(out, F.bit_count(failed) <= F.lit(policy.tolerance))


def ablations(ledger: DataFrame, policy: Policy = PRODUCTION, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and what would be
    kept without it; plus the bits that ever failed together with it.

    First one count per distinct failure pattern (combined map-side; at most 2**rules rows), then
    bitwise arithmetic on the patterns.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    used = [r for r in rules if policy.mask >> r.bit & 1]
    names = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used]))
    x = patterns.select("bits", "n", names.alias("r")).select("bits", "n", "r.*")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    fits = lambda bits: F.bit_count(bits) <= F.lit(policy.tolerance)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("rule", "bit").agg(
        total(hit).alias("n_failed"), total(~fits(F.col("bits")) & fits(without)).alias("n_only"),
        total(fits(F.col("bits"))).alias("n_kept"), total(fits(without)).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("co_failed"))


def quality_filter(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents the policy keeps, with all their columns: one narrow pass, no join.

    Documents below the base limits go whatever the policy tolerates.
    """
    clash = "lacuna_keep"
    while clash in docs.columns:
        clash += "_"
    schema = docs.withColumn(clash, F.lit(True)).schema
    at = docs.columns.index("text")
    plain, tolerance, bits = list(RULES), policy.tolerance, policy.mask
    checks = [(r.bit, compile(_python(r.fails), r.name, "eval")) for r in plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x in batch.column(at).to_pylist():
                m = dict(zip(MEASURES, measures(x)))
                failed = sum(1 << bit for bit, check in checks if eval(check, {"__builtins__": {}}, m))
                keep.append(not failed & BASE and (failed & bits).bit_count() <= tolerance)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.bool_())], names=[*batch.schema.names, clash]).filter(pc.field(clash))

    return docs.mapInArrow(run, schema).drop(clash)


def _python(sql: str) -> str:
    return sql.replace(" AND ", " and ").replace(" OR ", " or ")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then the ledger's failure bits."""
    ledger = evaluate_rules(table(spark, sf_dir, "documents"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return apply_policy(ledger).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "fail_bits")


def oracle_quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM d),
win AS (SELECT rid, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS g
        FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, unnest([0, 1, 2]) AS t(k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln
        WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
m AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        coalesce(dup.n_lines, 0)::BIGINT AS n_lines,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS n_letters
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)),
f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {BASE}) <> 0 AS base_failed,
  (fail_bits & {BASE}) = 0 AND bit_count(fail_bits & {PRODUCTION.mask}) <= {PRODUCTION.tolerance} AS kept, fail_bits
FROM f"""
