"""Quality, mixing, line dedup, SimHash, PII, LM, chat on small fixtures, with the awkward rows every stage must take."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lacuna.llm import chat, components, lines, lm, mixing, pii, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'xyz'[i % 3]}" for i in range(300)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def fixture_rows():
    base = [prose(i, 80) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0", 0), (20, base[0], "en", "s0", 0), (21, base[1].replace(base[1].split()[40], "changed", 1), "en", "s1", 0)]
    rows += [(30, None, None, None, None), (31, "", "en", "s9", 0), (None, "just one", "en", None, 0), (32, "\n \n\t", "en", "s1", 0), (33, "word " * 30000, "en", "s2", 0)]
    rows += [(40, base[2] + "\nshared footer line with words\n" + base[3][:200], "en", "s1", 0), (41, "Shared Footer: line, with words!\nnew 123 line here", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ quality
def test_ledger_policies_and_ablations(docs):
    ledger = quality.evaluate_rules(docs.withColumn("n_words", F.lit(-1))).cache()
    rows = ledger.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[30].n_words == by[31].n_words == by[32].n_words == 0 and by[33].n_repeat_words == 30000
    for policy in quality.POLICIES:
        kept = quality.apply_policy(ledger, policy).where("kept").count()
        for a in quality.ablations(ledger, policy).collect():
            others = [r for r in quality.RULES if policy.mask >> r.bit & 1 and r.name != a.rule]
            want = sum(sum(x.fail_bits >> r.bit & 1 for r in others) <= policy.tolerance for x in rows)
            assert (a.n_kept, a.n_kept_without) == (kept, want)
            assert a.n_failed == sum(x.fail_bits & a.bit != 0 for x in rows)
    out = quality.quality_filter(docs.withColumn("lacuna_keep", F.lit(7)))
    assert out.columns == [*docs.columns, "lacuna_keep"]
    want = sorted((x.doc_id for x in quality.apply_policy(ledger).where("kept").collect()), key=str)
    assert sorted((r.doc_id for r in out.collect()), key=str) == want


def test_measures_by_hand():
    assert quality.measures("a b c a b c\nx\nx\n \n \x1fé #")[:6] == (10, 11, 1, 1, 6, 4)
    assert quality.measures(None) == quality.measures("") == (0,) * 8


# ------------------------------------------------------------------ mixing
def test_mix_meets_targets_and_repeats(docs, empty):
    rows = mixing.plan_mix(docs).collect()
    again = mixing.plan_mix(docs.repartition(5)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(rows) == key(again) and len(rows) == docs.count()
    size = Counter()
    for r in rows:
        size[r.source] += r.size
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target = sum(size.values()), {}
    open_ = set(order)
    left = float(total)
    while True:  # capped sources leave, the rest share what is left
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        capped = {s for s in open_ if share[s] > 3 * size[s]}
        if not capped:
            target |= share
            break
        for s in capped:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= capped
    for r in rows:
        assert r.target == pytest.approx(target[r.source])
    for s in order:
        sizes = [r.size for r in rows if r.source == s]
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 2 * max(sizes) + 1
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# ------------------------------------------------------------------ components
def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want


# ------------------------------------------------------------------ line dedup
def brute_lines(rows):
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    occ = {}
    for d, text in sorted({(r[0] if r[0] is not None else -(1 << 63), r[1]) for r in rows if r[1] is not None}):
        for i, x in enumerate(text.split("\n")):
            if norm(x):
                occ.setdefault(norm(x), set()).add((d, i))
    names = list(occ)

    group = list(range(len(names)))

    def close(a, b):
        limit = math.floor(0.2 * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > limit:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1] <= limit

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    for i in range(len(names)):
        for j in range(i):
            if close(names[i], names[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    keep = {g: min(min(occ[names[i]]) for i in range(len(names)) if group[i] == g) for g in set(group)}
    gone = {}
    for i, x in enumerate(names):
        for d, n in occ[x]:
            if (d, n) != keep[group[i]]:
                gone.setdefault(d, set()).add(n)
    return {d: sorted(x) for d, x in gone.items()}


def test_line_dedup_against_brute_force(spark, docs, empty):
    stem = prose(99, 60).split()
    near = [(100 + i, " ".join([*stem[:i], "zz", *stem[i + 1:]]) + "\nend", "en", "s", 0) for i in range(6)]
    rows = [r for r in fixture_rows() if r[0] != 33] + near
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_key: list(r.dropped) for r in lines.dropped_lines(frame).collect()}
    assert got == brute_lines(rows)
    out = lines.dedup_lines(frame.withColumn("row", F.lit(1)))
    assert out.columns == [*SCHEMA_COLUMNS, "row"]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert 20 not in texts and texts[30] is None and texts[31] == ""  # 20 lost its only line
    assert lines.dedup_lines(empty).count() == 0


def test_lines_that_differ_in_numbers_stay_and_repeated_rows_go(spark):
    texts = ["Invoice 17 total 340 EUR", "Invoice 92 total 8 EUR", "12 | 34.5 | 6", "98 | 76.5 | 4", "* * *", "12 | 34.5 | 6\n* * *\nlast", "क\u093f", "क\u0941"]
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_key: list(r.dropped) for r in lines.dropped_lines(frame).collect()} == {5: [0, 1]}
    assert {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()} == dict(enumerate(texts)) | {5: "last"}


def test_rows_of_one_or_no_id_lose_their_own_lines_only(spark):
    a, b, c, d = (prose(i, 12) for i in (501, 502, 503, 504))
    rows = [(None, f"{a}\n{b}", "", "", 0), (None, f"{c}\n{a}", "", "", 0), (7, d, "", "", 0), (7, f"{d}\nfin", "", "", 0), (7, "alone", "", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert Counter((r.doc_id, r.text) for r in lines.dedup_lines(frame).collect()) == Counter([(None, f"{a}\n{b}"), (None, c), (7, d), (7, "fin"), (7, "alone")])


SCHEMA_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def edited(rng, line, rate, words):
    """``line`` with some words or characters replaced, dropped or put in, at places of their own."""
    units = line.split(" ") if words else list(line)
    for at in sorted(rng.choice(len(units), max(1, round(rate * len(units))), replace=False), reverse=True):
        new = WORDS[rng.integers(300)][::-1] if words else "abcdefghij"[rng.integers(10)]
        units[at:at + 1] = [[new], [], [units[at], new]][rng.choice(3, p=[0.6, 0.2, 0.2])]
    return (" " if words else "").join(units)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_recall_against_edit_similarity_alone(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for n in (5, 10, 20, 50):
        for rate, words in ((0.05, True), (0.1, True), (0.18, True), (0.02, False), (0.04, False)):
            for _ in range(12):
                a = prose(int(rng.integers(1 << 30)), n)
                b = edited(rng, a, rate, words)
                if a != b and distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9):
                    pairs.append((n, rate, words, a, b))
    frame = spark.createDataFrame([(2 * i + k, p[3 + k], "", "", 0) for i, p in enumerate(pairs) for k in (0, 1)], SCHEMA)
    gone = {r.doc_key for r in lines.dropped_lines(frame).collect()}
    found = {kind: np.mean([2 * i + 1 in gone for i, p in enumerate(pairs) if p[1:3] == kind]) for kind in sorted({p[1:3] for p in pairs})}
    print(len(pairs), found)
    assert not any(d % 2 == 0 for d in gone) and all(x >= 0.9 for x in found.values()), found


def test_long_lines_are_counted_in_pieces(spark):
    words = " ".join(f"{a}{b}{c}" for a in WORDS[:60] for b in "abcdefg" for c in "mnopqr")
    frame = spark.createDataFrame([(1, words)], "node long, norm string")
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words.split()]
    assert len(set(words.split())) == len(h) > 2 * lines.PIECE
    want = sum(1 << b for b in range(lines.BITS) if 2 * sum(v >> b & 1 for v in h) > len(h))
    assert lines.simhashes(frame).first().sim == want


def test_variants_of_one_line_and_very_long_lines(spark):
    """Eleven variants of a line of eleven words, a word replaced in each; two lines of 40,000 characters with an edit; a text of 3,000 lines."""
    stem = [f"{w}{i}" for i, w in enumerate(prose(7, 11).split())]
    rows = [(i, " ".join([*stem[:i], "other", *stem[i + 1:]]), "", "", 0) for i in range(11)]
    long = prose(8, 8000).split()
    rows += [(20, " ".join(long), "", "", 0), (21, " ".join([*long[:900], "new", *long[901:]]), "", "", 0)]
    rows += [(30, "\n".join(f"{i} {i * i}" for i in range(40000)) + "\n0 0", "", "", 0)]
    gone = {r.doc_key: list(r.dropped) for r in lines.dropped_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(gone) - {30} == {*range(1, 11), 21} and 3000 in gone[30] and 0 not in gone[30]


def test_kept_text_is_linear_and_exact(spark):
    cases = [("a\nb\nc", [0]), ("a\nb\nc", [1]), ("a\nb\nc", [2]), ("a\nb\nc", [0, 1, 2]), ("\na\n\nb\n", [1, 3]), ("a", None), (None, None), ("\n".join(map(str, range(200000))), list(range(0, 200000, 2)))]
    frame = spark.createDataFrame(cases, "text string, dropped array<int>")
    got = [r.x for r in frame.select(lines.kept_text(F.col("text"), F.col("dropped")).alias("x")).collect()]
    assert got == [t if d is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(d)) for t, d in cases]


def test_simhash_against_brute_force(spark, docs, empty):
    rows = fixture_rows()
    got = sorted(((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((r[0] for r, x in zip(rows, comp) if x == c and r[0] is not None), default=None) for c in set(comp)}
    assert got == sorted(((str(r[0]), f, least[c]) for r, f, c in zip(rows, fps, comp)), key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs.withColumn("fp", F.lit(0)))
    assert kept.columns == [*docs.columns, "fp"] and 20 not in {r.doc_id for r in kept.collect()}


def test_grid_join_loses_no_link(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    frame = spark.createDataFrame([(int(x.view(np.int64)),) for x in fp], "fp long").repartition(4)
    links = simhash.near_links(frame)
    got = {r.node: r.component for r in components.connected_components(links, "a", "b").collect()}
    group = list(range(len(fp)))
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 4):
            a, b = group[i], group[j]
            if a != b:
                group = [b if g == a else g for g in group]
    signed = fp.view(np.int64)
    for i in range(len(fp)):
        same = [int(signed[j]) for j in range(len(fp)) if group[j] == group[i]]
        assert got.get(int(signed[i]), int(signed[i])) == min(same)


def test_manhattan_never_exceeds_hamming():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    assert (simhash.manhattan(simhash._embed(a), simhash._embed(b)) <= np.bitwise_count(a ^ b)).all()


# ------------------------------------------------------------------ PII
def test_pii_spans_terms_and_sanitising(spark, docs, empty):
    rows = [(i, f"write to Zorblatt Quux at zq@corp.example.com now {prose(i, 20)}", "", "", 0) for i in range(5)]
    rows += [(10 + i, prose(50 + i, 40), "", "", 0) for i in range(400)]
    rows += [(1000, "é +1 (555) 123-4567, 4111 1111 1111 1111 / 10.0.0.255 / 300.1.1.1", "", "", 0), (1001, None, "", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = {r.doc_id: r for r in pii.with_terms(frame, pii.detect(frame)).collect()}
    assert [(s.kind, s.s, s.e) for s in plan[1000].spans] == [("ip", 43, 53), ("card", 21, 40), ("phone", 2, 19)]
    terms = {t.m for t in plan[0].terms}
    assert {"zorblatt", "quux"} <= terms and all(len(plan[10 + i].terms) == 0 for i in range(400))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, remove_bits=99.0).collect()}
    assert "<EMAIL>" in clean[0] and "Zorblatt" not in clean[0] and "<TERM>" in clean[0] and clean[1001] is None
    assert clean[1000] == "é <PHONE>, <CARD> / <IP> / 300.1.1.1"
    assert pii.with_terms(docs, pii.detect(docs)).count() == docs.count()
    assert pii.with_terms(empty, pii.detect(empty)).count() == 0


def test_sanitising_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "mail a.b@c.example or", "", "", 0), (None, "no data", "", "", 0), (7, "x +1 (555) 123-4567", "", "", 0), (7, "at 10.0.0.255 now, d@e.example", "", "", 0), (7, None, "", "", 0)]
    got = pii.sanitise(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, "mail <EMAIL> or"), (None, "no data"), (7, "x <PHONE>"), (7, "at <IP> now, <EMAIL>"), (7, None)])


def test_terms_reveal_from_anywhere_in_a_text(spark):
    far = lambda i: f"contact Zorblatt for details about the delivery schedule of goods here: zq@corp.example.com thanks {prose(i, 30)} Zorblatt, again"
    rows = [(i, far(i), "", "", 0) for i in range(6)] + [(10 + i, f"again: details about the delivery schedule of goods for us here thanks, contact {prose(70 + i, 30)}", "", "", 0) for i in range(600)]
    copies = [(900 + i, f"one text many times by Quibble at copy@same.example.com {prose(5, 20)}", "", "", 0) for i in range(5)]
    frame = spark.createDataFrame(rows + copies, SCHEMA)
    got = {r.doc_id: r for r in pii.with_terms(frame, pii.detect(frame)).collect()}
    for i in range(6):
        assert [t.m for t in got[i].terms] == ["zorblatt", "zorblatt"] and all(rows[i][1][t.s:t.e] == "Zorblatt" for t in got[i].terms)
    assert not any(got[r[0]].terms for r in rows[6:])
    assert not any(got[r[0]].terms for r in copies)  # copies of one text are no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(frame, remove_bits=6.0).collect()}
    assert clean[0].startswith("contact  for details") and "<EMAIL> thanks" in clean[0] and "orblatt" not in clean[0]


def test_disclosures_against_brute_force(spark):
    rng = np.random.default_rng(3)
    people = [(f"P{i}x", f"{'abcdefgh'[i]}.x@mail.example.com") for i in range(8)]
    rows = []
    for i in range(700):
        words = prose(1000 + i, 15).split()
        for name, mail in people:
            if rng.random() < 0.012:
                words.insert(int(rng.integers(0, len(words))), mail)
                words += [name] * int(rng.random() < 0.7)
            elif rng.random() < 0.004:
                words.append(name)
        rows.append((i, " ".join(words), "", "", 0))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = pii.detect(frame)
    limits = dict(posterior=0.4, bits=5.0, support=2)
    got = {(r.row_id, r.term): r.gain for r in pii.disclosures(frame, found, **limits).join(found.select("row", "doc_id"), "row").selectExpr("doc_id AS row_id", "term", "gain").collect()}
    sets = {i: {w.lower() for w in t.split()} for i, t, *_ in rows}
    holds = {m: {i for i, s in sets.items() if m in s} for _, m in people}
    with_term = {}
    for i, s in sets.items():
        for w in s:
            with_term.setdefault(w, set()).add(i)
    best = {}
    for mail, e in holds.items():
        for w, t in with_term.items():
            n = len(e & t)
            if n >= 2 and n / len(t) >= 0.4 and math.log2(n / len(t) * len(rows) / len(e)) >= 5.0:
                for i in e & t:
                    best[i, w] = max(best.get((i, w), 0.0), math.log2(n / len(t) * len(rows) / len(e)))
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in with_term], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert len(best) > 20 and got == {(i, hashed[w]): pytest.approx(g) for (i, w), g in best.items()}


def test_many_spans_in_one_text(spark):
    n = 100_000
    text = " ".join(f"é{i} a{i}@x.example" for i in range(n))
    frame = spark.createDataFrame([(1, text, "", "", 0), (2, "x" * 9000 + " b@c.example " + "y" * 5000, "", "", 0)], SCHEMA)
    start = time.perf_counter()
    spans = {r.doc_id: r.spans for r in pii.detect(frame).collect()}
    assert time.perf_counter() - start < 30 and len(spans[1]) == n
    assert all(text[x.s:x.e] == x.m for x in spans[1][:: n // 50])
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[1] == " ".join(f"é{i} <EMAIL>" for i in range(n)) and clean[2] == "x" * 9000 + " <EMAIL> " + "y" * 5000
    over = spark.createDataFrame([(1, "card 4111 1111 1111 1111, +4111 1111 1111 111 x", "", "", 0)], SCHEMA)  # overlapping spans are one
    assert re.fullmatch(r"card <CARD>, <(PHONE|CARD)> x", pii.sanitise(over).first().text)


# ------------------------------------------------------------------ LM
def test_lm_base_scores_and_held_out_gain(docs, empty):
    rows = fixture_rows()
    tokens = [[*(r[1] or "").encode().lower().split(), 0] for r in rows]
    rem = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 for r in rows]
    c = Counter(w for t, m in zip(tokens, rem) if m != 2 for w in t)
    N, V = sum(c.values()), len(c)
    want = sorted((str(r[0]), m == 2, len(t), sum(w in c for w in t), N, round(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in t), 5)) for r, t, m in zip(rows, tokens, rem))
    got = lm.score_documents(docs, chunk_bytes=3000).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    whole = {(str(r.doc_id), round(r.score, 6)) for r in lm.score_documents(docs).collect()}
    assert whole == {(str(r.doc_id), round(r.score, 6)) for r in got}  # chunking changes nothing
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_weights_do_not_drift_with_the_vocabulary():
    for n in (1000, 10**6, 5 * 10**9, 10**12):
        step = lm._step(n)
        p = np.array([1.0, 0.5, 0.055, 0.003, 1e-3, 1 / n])
        assert np.abs(np.log2(p) - (lm._level(p, step) - lm.LEVELS + 1) * step).max() <= step / 2 + 1e-9
    # half of the tokens after a sure bigram, half after none: the bigram's weight is about the sure half's share
    weights = []
    for v in (1000, 20 * 10**6):
        step = lm._step(10**8)
        level = lambda p: int(lm._level(np.array([p]), step)[0])
        cells = [(5 * lm.LEVELS + level(0.01)) * lm.LEVELS + level(p) for p in (1.0, 0.0)]
        weights.append(lm.em(lm.pd.DataFrame({"cell": cells, "n": [50, 50]}), 1 / (v + 1), step)[5, 2])
    assert weights[0] == pytest.approx(weights[1], abs=0.01) and 0.45 < weights[0] < 0.5


def test_scores_against_plain_counts_and_held_out_gain(spark, monkeypatch):
    w = np.tile([0.1, 0.3, 0.6], (lm.BUCKETS, 1)) * np.linspace(1, 0.9, lm.BUCKETS)[:, None]
    chain = [" ".join(WORDS[(7 * i + k * (1 + i % 3)) % 300] for k in range(60)) for i in range(60)]
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(chain)], SCHEMA)
    learned = lm.score_documents(frame).where("held_out").agg(F.count("*"), F.sum("score"), F.sum("base_score")).first()
    assert learned[0] > 3 and learned[1] > learned[2] + 0.2 * 61 * learned[0]  # a fifth of a decimal digit a token
    monkeypatch.setattr(lm, "learn_weights", lambda joined, stats: w)
    tokens = [[*t.encode().split(), lm.END] for t in chain]
    train = [t for i, t in enumerate(tokens) if lm.remainder(i) != lm.HELD_OUT]
    one, two, ctx = Counter(x for t in train for x in t), Counter(), Counter({lm.START: len(train)})
    for t in train:
        two.update(zip([lm.START, *t[:-1]], t))
        ctx.update(t[:-1])
    n, v = sum(one.values()), len(one)
    for r in lm.score_documents(frame).collect():
        want = 0.0
        for a, b in zip([lm.START, *tokens[r.doc_id][:-1]], tokens[r.doc_id]):
            u = w[min(1 + int(math.log2(ctx[a])), lm.BUCKETS - 1) if ctx[a] else 0]
            want += math.log10(u[0] / (v + 1) + u[1] * one[b] / n + (u[2] * two[a, b] / ctx[a] if ctx[a] else 0))
        assert r.score == pytest.approx(want)


def test_mixture_is_a_distribution():
    n, v = 100, 9
    counts = np.array([40, 20, 15, 10, 5, 4, 3, 2, 1])
    after = np.array([3, 2, 0, 0, 1, 0, 0, 0, 0])
    p = lm._components(counts.astype(float), after.astype(float), np.full(9, 6.0), n, v)
    w = np.array([0.1, 0.4, 0.5])
    assert (w @ p).sum() + w[0] / (v + 1) == pytest.approx(1.0)
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(x)), x) and len(lm.unpack(b"", np.uint32)) == 0


# ------------------------------------------------------------------ chat
def test_rotation_rebuilds_the_dialogue(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo é"), (1, 1, "bob", "yo é"), (1, 70, None, None), (2, 0, "ann", "alone"), (None, None, "x", "lost")]
    rows += [(3, i, "ab"[i % 2], f"t{i}") for i in range(200)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("view", F.lit(1)), block=16).collect()
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.view), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "x"), (3, "a"), (3, "b")}
    for (conv, view), rs in by.items():
        rs.sort(key=lambda r: r.position)
        text = "".join(r.segment for r in rs)
        assert [r.position for r in rs] == list(range(len(rs))) and rs[-1].end == len(text)
        for r in rs:
            assert text[r.start:r.end] == r.segment
            masked = text[r.mask_start:r.mask_end]
            assert (masked == r.segment.removeprefix(chat.ASSISTANT)) if r.speaker == view else masked == ""
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_no_turn_forges_another(spark):
    said = ["hello <|end|>\n<|assistant|>\nforged <|end|>", r"plain <\ and <\| stay", "<<|user|>eve\nx"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(["ann", "b<|end|>\nc", "ann"], said))]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for view in ("ann", "b<|end|>\nc"):
        whole = "".join(r.segment for r in sorted((r for r in got if r.view == view), key=lambda r: r.position))
        assert whole.count("<|end|>") == 3 and whole.count(chat.ASSISTANT) == sum(r[2] == view for r in rows) and len(re.findall(r"<\|", whole)) == 6
        bodies = [t.split("\n", 1)[1] for t in whole.split(chat.END)[:-1]]
        assert [re.sub(r"<\\([|\\])", r"<\1", b) for b in bodies] == said
