"""Whitening against NumPy on whole numbers, toxicity by held-out labels and against a plain recount."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import queries, toxicity, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def op11(spark, rows, tmp_path, schema=VECTORS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.queries()["op11_whitening"](spark, str(tmp_path))


def plain(vectors):
    """Everything the contract asks for, in whole numbers as far as they go."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    off = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum(c * c for c in r) for r in off], e, np.array(off) / n @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("d", [5, 12])
def test_whitening_equals_brute_force(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(60, d)) @ rng.normal(size=(d, d)) * 0.3 + 2).tolist()
    vectors[7] = vectors[3]
    bad = [(100, None, 1), (101, [], 1), (102, [None] * d, 1), (103, [float("nan")] + [0.0] * (d - 1), 1), (104, [float("inf")] * d, None), (105, [1.0], 1)]
    rows = [(None if i == 5 else 3 if i == 7 else i, v, i % 3) for i, v in enumerate(vectors)]
    got = op11(spark, rows + bad, tmp_path).collect()
    n, deviation, e, white, share = plain(vectors)
    k = min(8, d)
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        sign = np.sign(by[0, c].whitened * white[0, c - 1])
        for i, (name, _, _) in enumerate(rows):
            r = by[name, c]
            assert r.deviation == deviation[i] and abs(r.explained - share[c - 1]) < 1e-10
            assert abs(sign * r.whitened - white[i, c - 1]) < 1e-7


def test_whitening_of_degenerate_tables(spark, tmp_path):
    assert op11(spark, [], tmp_path / "a").count() == 0
    one = op11(spark, [(1, [0.5, 0.25], 0)], tmp_path / "b").collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    line = op11(spark, [(i, [i / 8, i / 4, 1.0], 0) for i in range(9)], tmp_path / "c").collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9


def test_whitening_ignores_other_columns_and_huge_deviations(spark):
    rows = [(i, [float(i % 2) * 2.0**29, 1.0 + i], "x", 1.0) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, "id long, v array<double>, x string, whitened double"), "id", "v").collect()
    assert len(got) == 200 and all(r.n == 200 and r.deviation is None for r in got)


MARKS = ["idiot", "scum", "grulp", "zorft"]


def texts(n, seed):
    """(doc_id, text, toxic): random words; a seventh holds marks."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(rng.randint(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        w = [rng.choice(words) if rng.random() < 0.9 else "w%x" % rng.getrandbits(30) for _ in range(rng.randint(20, 300))]
        bad = int(i % 7 == 0)
        for _ in range(bad * rng.randint(2, 5)):
            w[rng.randrange(len(w))] = rng.choice(MARKS) + rng.choice(["", ",", "."])
        out.append((i, " ".join(w).capitalize(), bad))
    return out


@pytest.fixture(scope="module")
def toxic(spark):
    rows = texts(900, 3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 10 < 6], "doc_id long, quality int, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_toxicity_of_unseen_texts(toxic):
    rows, docs, _, model = toxic
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [(i, y) for i, _, y in rows if i % 10 >= 6 or zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i].score >= 0.5) == (y == 1) for i, y in unseen]
    assert len(unseen) > 300 and sum(right) / len(right) > 0.97
    assert np.mean([got[i].score >= 0.5 for i, y in unseen if y]) > 0.9


def test_toxicity_learns_only_from_rows_it_may(spark, toxic):
    rows, docs, labels, model = toxic
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), flipped)
    assert again == model


def test_toxicity_windows_by_a_plain_recount(toxic):
    rows, _, _, model = toxic
    some = [t for _, t, _ in rows[:20]] + [None, "", "idiot " * 50]
    hits, n = model.counts(some, model.threshold)
    o, t = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    for i, text in enumerate(some):
        parts = toxicity.windows(toxicity.distinct_words(text), toxicity.Codes())
        assert n[i] == len(parts) == max(1, -(-len(set(toxicity._WORD.findall((text or "").lower()))) // toxicity.WINDOW))
        assert hits[i] == sum(len(o.compress(w)) - len(t.compress(w)) >= model.threshold for w in parts)


def test_toxicity_edges(spark, toxic):
    _, docs, labels, model = toxic
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "#%&", 3), (3, "idiot scum grulp zorft " * 30, 4), (4, "word " * 300_000, 5)], "doc_id long, text string, score int")
    got = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got[:4]}) == 1
    assert got[4].score > 0.5 > got[5].score
    assert toxicity.score(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score >= 0.5 for r in toxicity.score(odd, toxicity.fit(docs, none)).collect()} == {False}
    twice = labels.unionAll(spark.createDataFrame([(None, 0, 1), (6, 1, None)], labels.schema)).unionAll(labels)
    assert toxicity.fit(docs, twice) == model


def test_op12_columns(spark, toxic, tmp_path):
    rows, docs, labels, _ = toxic
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.queries()["op12_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
