"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, rewritten so that Java's engine needs linear time and constant stack on
#: hostile texts. A match can only start where the plain pattern's leftmost one does, and
#: possessive runs give up nothing that the plain pattern would give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole chains of 16 to 19 digits; the plain pattern matches every chain of two or more
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its pattern is tried.
_HINTS = {"ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|)"
SPAN = "struct<kind:string,s:int,e:int,m:string>"

#: A term: from the first to the last letter, mark or digit of a word.
TERM = r"[\p{L}\p{M}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{M}\p{N}])?"
#: A term reveals an entity at this posterior, information gain (bits) and number of different texts; from
#: ``REMOVE`` bits on it goes altogether.
POSTERIOR, BITS, SUPPORT, REMOVE = 0.5, 6.0, 3, 12.0
#: Lengths of a run of prefix sums, code points of a block of a sanitised text.
RUN, BLOCK = 128, 4096


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(n: Column) -> Column:
    """struct<at, out>: the sum of a short array of ints, and the sums before each of its entries."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(n, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))


def _starts(sizes: Column) -> Column:
    """The sums before each entry of an array of ints: within runs of ``RUN`` entries, then over the runs, so that no array grows entry by entry."""

    def add(n: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")), lambda k: _before(F.slice(n, k * RUN + 1, F.lit(RUN))))
        whole = _let(runs, lambda r: F.flatten(F.zip_with(r, _before(F.transform(r, lambda x: x["at"]))["out"], lambda x, at: F.transform(x["out"], lambda v: v + at))))
        return F.when(F.size(n) > RUN, whole).otherwise(_before(n)["out"])

    return _let(sizes, add)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches with code-point offsets, end exclusive.

    What lies between the matches gives their places: split and extract walk the text alike.
    """

    def places(gaps: Column, m: Column) -> Column:
        steps = F.zip_with(gaps, m, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("n"), x.alias("m")))
        return _let(F.filter(steps, lambda x: x["m"].isNotNull()), lambda hits: F.zip_with(hits, _starts(F.transform(hits, lambda x: x["gap"] + x["n"])), lambda x, at: F.struct(
            (at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["m"].alias("m"))))

    return places(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(digits)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<SPAN> of one text: by kind as listed, then by start."""
    return F.concat(*[_kind_spans(text, kind) for kind in KINDS])


def _kind_spans(text: Column, kind: str) -> Column:
    hint = {"email": "@", "phone": "+"}.get(kind)
    tried = F.contains(text, F.lit(hint)) if hint else text.rlike(_HINTS[kind])
    hits = F.filter(find_all(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
    named = F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.when(tried, named.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(row, doc_id, key, spans, words, text)``, staged: base spans and a digest of the text; for texts that hold a span
    also the hashes of their different terms and the text itself.

    One narrow pass. A null text counts as empty; very long texts are searched whole, in time linear in their spans; repeated
    rows get a ``row`` number each, or keep that of ``row_col``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    found = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "row", "doc_id", F.xxhash64("text").alias("key"), "text", base_spans(F.col("text")).alias("spans"))
    held = F.size("spans") > 0
    return stage(found.select("row", "doc_id", "key", "spans", F.when(held, _terms(F.col("text"))).alias("words"), F.when(held, F.col("text")).alias("text"), F.sha2("text", 256).alias("text_sha256")), "spans")


def _terms(text: Column) -> Column:
    """The 64-bit hashes of a text's different terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def _set_of(row: str, name: str) -> list[Column]:
    """Two 64-bit digests of the set of rows of a group: equal for groups of the same rows."""
    return [F.bit_xor(F.xxhash64(row, F.lit(i))).alias(f"{name}{i}") for i in (0, 1)]


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n_term, t0, t1)``: in how many documents each term's hash occurs, and a digest of which.

    Over all documents: distinct terms of a document first, then counts combined map-side, so a
    word of every document is one row a task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.monotonically_increasing_id().alias("row"), _terms(text).alias("words")).select("row", F.explode("words").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"), *_set_of("row", "t"))


def disclosures(docs: DataFrame, found: DataFrame, posterior: float = POSTERIOR, bits: float = BITS, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """``(row, term, gain)``: the terms, by hash, that reveal an entity of their document, anywhere in it.

    An entity is a distinct value of a base span. The posterior is the share of the documents with the term that
    hold the entity; ``gain`` the pointwise mutual information in bits, log2 of the posterior over the entity's share of all
    documents, the largest over the document's entities. Pairs in fewer than ``support`` different texts are no evidence.

    No pair is formed that can't reach the thresholds: they bound an entity's documents by its share, a term's by the
    entity's. Entities, and terms, of the same documents are one class and meet once: a list copied over
    several documents is one pair, not names times numbers.
    """
    n_docs = found.count()
    most = n_docs / 2.0**bits
    held = found.where(F.size("spans") > 0)
    has = held.select("row", "key", F.explode("spans").alias("x")).select("row", "key", "x.kind", F.lower("x.m").alias("value")).distinct()
    entity = has.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_entity"), F.count_distinct("key").alias("texts"), *_set_of("row", "e"))
    entity = entity.where((F.col("texts") >= support) & (F.col("n_entity") <= most)).drop("texts")
    who = stage(has.join(entity, ["kind", "value"]).select("row", "key", "e0", "e1", "n_entity").distinct(), "entities")
    term = term_documents(docs, text_col).where((F.col("n_term") >= support) & (F.col("n_term") <= most / posterior))
    what = stage(held.join(who.select("row").distinct(), "row", "left_semi").select("row", F.explode("words").alias("term")).join(term, "term"), "terms")
    pair = who.join(what.select("row", "t0", "t1", "n_term").distinct(), "row").where(F.col("n_term") * posterior <= F.col("n_entity"))
    ids = ["e0", "e1", "t0", "t1"]
    both = pair.groupBy(*ids, "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"), F.count_distinct("key").alias("texts")).where(F.col("texts") >= support)
    share = F.col("n_both") / F.col("n_term")
    gain = F.log2(share * n_docs / F.col("n_entity"))
    reveal = both.where((share >= posterior) & (gain >= bits)).select(*ids, gain.alias("gain"))
    return pair.join(reveal, ids).groupBy("row", "t0", "t1").agg(F.max("gain").alias("gain")).join(what, ["row", "t0", "t1"]).select("row", "term", "gain")


def with_terms(docs: DataFrame, found: DataFrame, **limits) -> DataFrame:
    """``found`` plus ``terms``: every place of a revealing term in the texts that hold its entity, outside the base spans."""
    hits = stage(disclosures(docs, found, **limits), "hits")
    texts = found.join(hits.select("row").distinct(), "row", "left_semi")
    words = texts.select("row", F.explode(find_all(F.col("text"), TERM)).alias("w")).select("row", "w.*", F.xxhash64(F.lower("w.m")).alias("term")).join(hits, ["row", "term"])
    words = words.select("row", "s", "e", F.lower("m").alias("m"), "gain")
    spans = texts.select("row", F.explode("spans").alias("x")).select("row", "x.s", "x.e", F.lit(None).cast("string").alias("m"), F.lit(None).cast("double").alias("gain"))
    # a text's spans and words by their start: a word must start after every span before it has ended, and end before the next one starts
    by_start = Window.partitionBy("row").orderBy("s", F.col("m").isNotNull())
    span = lambda c: F.when(F.col("m").isNull(), F.col(c))
    ended = F.coalesce(F.max(span("e")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    back = Window.partitionBy("row").orderBy(F.desc("s"), F.col("m").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.min(span("s")).over(back)
    free = words.unionByName(spans).withColumn("free", (F.col("s") >= ended) & F.coalesce(F.col("e") <= starts, F.lit(True))).where("free AND m IS NOT NULL")
    marked = free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "m", "gain"))).alias("terms"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,gain:double>>")
    return found.join(marked, "row", "left").withColumn("terms", F.coalesce("terms", empty))


def clean_texts(plan: DataFrame, remove_bits: float = REMOVE) -> DataFrame:
    """``(row, clean)`` of the rows of ``with_terms`` that hold a span: base spans become ``<KIND>``; revealing terms become
    ``<TERM>``, or go altogether at ``remove_bits`` of gain. Overlapping spans are one, named by the earlier, longer one.

    A text is cut into blocks of ``BLOCK`` code points, each with its own marks: no text is walked, or copied, once a mark.
    """
    held = plan.where(F.size("spans") > 0)
    marks = F.concat(
        F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("by"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["gain"] >= remove_bits, F.lit("")).otherwise(F.lit("<TERM>")).alias("by"))))
    by_start = Window.partitionBy("row").orderBy("s", F.desc("e"), "by")
    ended = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    each = held.select("row", F.explode(marks).alias("x")).select("row", "x.*").withColumn("new", F.coalesce(F.col("s") >= ended, F.lit(True)).cast("int"))
    each = each.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = each.groupBy("row", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("new") == 1, F.col("by"))).alias("by"))
    block = lambda c: F.floor(c / BLOCK).cast("int")
    parts = runs.select("row", "s", "e", "by", F.explode(F.sequence(block(F.col("s")), block(F.col("e") - 1))).alias("k"))
    at = F.col("k") * BLOCK
    cut = F.struct(F.greatest(F.col("s") - at, F.lit(0)).alias("s"), F.least(F.col("e") - at, F.lit(BLOCK)).alias("e"), F.when(F.col("s") >= at, F.col("by")).otherwise("").alias("by"))
    cuts = parts.groupBy("row", "k").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    blocks = held.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("k", "part")).join(cuts, ["row", "k"], "left")
    part = F.col("part")
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["e"])), F.col("cuts"), lambda end, x: F.when(x.isNull(), F.substring(part, end + 1, F.lit(BLOCK))).otherwise(
        F.concat(F.substring(part, end + 1, x["s"] - end), x["by"])))
    said = blocks.select("row", "k", F.when(F.col("cuts").isNull(), part).otherwise(F.array_join(pieces, "")).alias("part"))
    return said.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("clean"))


def sanitise(docs: DataFrame, remove_bits: float = REMOVE, **limits) -> DataFrame:
    """``docs`` with a sanitised ``text`` (see ``clean_texts``).

    Each row meets its own marks by a number given once, on staged rows, whatever its id. A null text stays null.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stage(docs.select(F.monotonically_increasing_id().alias("at"), whole.alias("whole")), "rows")
    texts = rows.select("at", "whole.doc_id", F.col("whole.text").cast("string").alias("text"))
    clean = clean_texts(with_terms(texts, detect(texts, row_col="at"), **limits), remove_bits).select(F.col("row").alias("at"), "clean")
    joined = rows.join(clean, "at", "left")
    return joined.select(*[F.coalesce("clean", "whole.text").alias("text") if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = with_terms(docs, detect(docs))
    clean = clean_texts(plan).select("row", F.sha2("clean", 256).alias("clean_sha256"))
    say = lambda kind, x: F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))
    base = F.transform("spans", lambda x: say(x["kind"], x))
    more = F.transform("terms", lambda x: say(F.lit("term"), x))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    gone = F.size(F.filter("terms", lambda x: x["gain"] >= REMOVE)).cast("long")
    return plan.join(clean, "row", "left").select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, more)).alias("spans"), (F.size("terms") - gone).alias("n_generalised"), gone.alias("n_removed"), F.coalesce("clean_sha256", "text_sha256").alias("clean_sha256"))


def oracle_pii() -> str:
    """The contract's plain patterns and the method's definitions as SQL."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    found = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {i} AS ko, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')"
        for i, (k, p) in enumerate(plain.items()))
    place = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
h AS (SELECT rid, kind, ko, m[i] AS m, ({place})::BIGINT AS s FROM f, unnest(range(1, len(m) + 1)) AS u(i)),
v AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM h),
b AS (SELECT rid, kind, ko, s, e, lower(m) AS value FROM v WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN regexp_full_match(m, '{part}(\.{part}){{3}}') WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INTEGER ELSE (digits[length(digits) - i]::INTEGER * 2) % 10 + (digits[length(digits) - i]::INTEGER * 2) // 10 END)) % 10 = 0 END),
ent AS (SELECT kind, value, count(DISTINCT b.rid) AS n_entity FROM b JOIN d USING (rid) GROUP BY ALL HAVING count(DISTINCT text) >= {SUPPORT}),
tm AS (SELECT rid, regexp_extract_all(text, '{TERM}') AS m, string_split_regex(text, '{TERM}') AS g FROM d WHERE regexp_matches(text, '{TERM}')),
df AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT rid, lower(unnest(m)) AS term FROM tm) GROUP BY 1),
eb AS (SELECT DISTINCT rid, kind, value, n_entity FROM b JOIN ent USING (kind, value)),
et AS (SELECT DISTINCT rid, lower(unnest(m)) AS term FROM tm WHERE rid IN (SELECT rid FROM eb)),
pair AS (SELECT kind, value, n_entity, term, n_term, count(*) AS n_both FROM eb JOIN et USING (rid) JOIN df USING (term) JOIN d USING (rid) GROUP BY ALL HAVING count(DISTINCT text) >= {SUPPORT}),
rv AS (SELECT *, log2(n_both / n_term::DOUBLE * (SELECT count(*) FROM d) / n_entity) AS gain FROM pair WHERE n_both / n_term::DOUBLE >= {POSTERIOR}),
hit AS (SELECT rid, term, max(gain) AS gain FROM rv JOIN eb USING (kind, value) JOIN et USING (rid, term) WHERE gain >= {BITS} GROUP BY ALL),
hw AS (SELECT rid, lower(m[i]) AS term, ({place})::BIGINT AS s, length(m[i]) AS n FROM tm, unnest(range(1, len(m) + 1)) AS u(i) WHERE rid IN (SELECT rid FROM hit)),
t AS (SELECT rid, s, s + n AS e, gain FROM hw JOIN hit USING (rid, term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = hw.rid AND b.s < hw.s + hw.n AND hw.s < b.e)),
mk AS (SELECT rid, s, e, '<' || upper(kind) || '>' AS w FROM b UNION ALL SELECT rid, s, e, CASE WHEN gain >= {REMOVE} THEN '' ELSE '<TERM>' END FROM t),
m1 AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY rid ORDER BY s, e DESC, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM mk),
m2 AS (SELECT *, count_if(fresh) OVER (PARTITION BY rid ORDER BY s, e DESC, w ROWS UNBOUNDED PRECEDING) AS run FROM m1),
m3 AS (SELECT rid, run, min(s) AS s, max(e) AS e, max(CASE WHEN fresh THEN w END) AS w FROM m2 GROUP BY ALL),
m4 AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS p FROM m3),
cl AS (SELECT rid, string_agg(substring(text, p + 1, s - p) || w, '' ORDER BY s) || substring(any_value(text), max(e) + 1, length(any_value(text))) AS clean FROM m4 JOIN d USING (rid) GROUP BY 1),
bs AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ko, s) AS x, count_if(kind = 'email') AS n_email, count_if(kind = 'ip') AS n_ip, count_if(kind = 'card') AS n_card, count_if(kind = 'phone') AS n_phone FROM b GROUP BY 1),
ts AS (SELECT rid, string_agg('term:' || s || ':' || e, ',' ORDER BY s) AS x, count_if(gain < {REMOVE}) AS n, count_if(gain >= {REMOVE}) AS r FROM t GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(bs.x, '')) AS base_sha256, concat_ws(',', bs.x, ts.x) AS spans, coalesce(ts.n, 0)::BIGINT AS n_generalised, coalesce(ts.r, 0)::BIGINT AS n_removed, sha256(coalesce(clean, text)) AS clean_sha256
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ts USING (rid) LEFT JOIN cl USING (rid)"""
