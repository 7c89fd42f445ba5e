"""Jobs over growing and repeated input: two runs, late and repeated rows, a batch cut off half way, command lines."""

import json
import logging
import math
import shutil
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from jobs import common, labelled_split, light_curves
from lacuna.streaming import EVENTS

START = datetime(2024, 1, 1)
SETTINGS = light_curves.Settings(period_days=5, files_per_batch=1)


def events(ids, step=7):
    """One event every ``step`` hours, two series, a gap and a spike."""
    for i in ids:
        value = None if i % 11 == 0 else float("nan") if i % 37 == 0 else 5000.0 if i == 40 else 10.0 + i % 3
        yield i, START + timedelta(hours=step * i), i % 2, "view", value, "{}"


def put(spark, rows, folder):
    spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def curves(spark, out):
    return sorted(tuple(r) for r in light_curves.read_curves(spark, str(out)).collect())


def test_growing_input_gives_what_one_run_gives(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "light_curves")
    src, out, mark = tmp_path / "events", tmp_path / "out", tmp_path / "mark"
    run = lambda: light_curves.archive(spark, str(src), str(out), str(mark), SETTINGS)
    put(spark, events(range(60)), src)
    first = run()
    assert first["batches"] == 1 and first["read"] == first["kept"] == 60
    before = curves(spark, out)
    assert run() == {"batches": 0, "read": 0, "kept": 0, "written": 0} and curves(spark, out) == before and "nothing new" in caplog.text
    late = [*events(range(60, 90)), *events(range(3, 6)), (500, START + timedelta(hours=1), 1, "late", 11.0, "{}"), (501, None, 1, "x", 1.0, None), (None, START, 1, "x", 1.0, None), (502, START, None, "x", 1.0, None)]
    put(spark, late, src)
    put(spark, [(503, START + timedelta(days=40), 7, "far", 0.0, "{}")], src)
    second = run()
    assert second["batches"] == 2 and second["read"] == len(late) + 1 and second["kept"] == len(late) - 2
    one = light_curves.archive(spark, str(src), str(tmp_path / "one"), str(tmp_path / "one-mark"), light_curves.Settings(period_days=5))
    assert one["batches"] == 1 and curves(spark, out) == curves(spark, tmp_path / "one")
    got = light_curves.read_curves(spark, str(out)).collect()
    assert Counter(r.event_id for r in got) == Counter([*range(90), 500, 503])
    spike = next(r for r in got if r.event_id == 40)
    assert spike.normalised is None and spike.n_flagged == 1 and next(r for r in got if r.event_id == 503).normalised is None
    by = defaultdict(list)
    for r in got:
        by[r.series_id, r.period].append(r)
    for (series, period), rows in by.items():
        good = [r for r in rows if r.flux is not None and r.event_id != 40]
        middle = sorted(r.flux for r in good)
        median = (middle[(len(good) - 1) // 2] + middle[len(good) // 2]) / 2
        days = {math.floor(r.t) for r in good}
        assert all(r.completeness == pytest.approx(len(days) / 5) and r.complete == (len(days) >= 2.5) and r.n == sum(x.flux is not None for x in rows) for r in rows)
        assert median == 0 or all(r.normalised == pytest.approx(r.flux / median) for r in good)


def test_a_batch_cut_off_runs_again(spark, tmp_path):
    src, out, mark = tmp_path / "events", tmp_path / "out", tmp_path / "mark"
    put(spark, events(range(30)), src)
    light_curves.archive(spark, str(src), str(out), str(mark), SETTINGS)
    want = curves(spark, out)
    for f in (mark / "commits").iterdir():  # as if the driver had died before the batch was committed
        f.unlink()
    shutil.rmtree(out / "curves" / "period=0")
    assert light_curves.archive(spark, str(src), str(out), str(mark), SETTINGS)["batches"] == 1
    assert curves(spark, out) == want


def test_an_empty_file_and_a_file_of_use_for_nothing(spark, tmp_path):
    src, out = tmp_path / "events", tmp_path / "out"
    put(spark, [(None, None, None, None, None, None)], src)
    done = light_curves.archive(spark, str(src), str(out), str(tmp_path / "mark"))
    assert done == {"batches": 1, "read": 1, "kept": 0, "written": 0}
    put(spark, events(range(4)), src)
    assert light_curves.archive(spark, str(src), str(out), str(tmp_path / "mark"))["written"] == 4


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    docs = [(i, f"text {i if i % 10 else 'same'} of some words", ["en", "de", None][i % 3], "s", 1) for i in range(200)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "no id here at all", "en", "s", 0), (902, "no label here at all", "en", "s", 0)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(5, 1, int(5 % 4 == 0)), (7, 1, 1), (900, 1, 0), (901, 1, 0), (None, 1, 0), (8, 1, None), (999, 1, 1)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{at}/documents")
    spark.createDataFrame(marks, LABELS).repartition(2).write.parquet(f"{at}/labels")
    return at


def test_split_by_class(spark, corpus, tmp_path, caplog):
    caplog.set_level(logging.INFO, "labelled_split")
    settings = labelled_split.Settings(min_words=2, shares={"train": 0.6, "validation": 0.2, "test": 0.2})
    run = lambda: labelled_split.build(spark, f"{corpus}/documents", f"{corpus}/labels", str(tmp_path), settings)
    counts = run()
    rows = labelled_split.read_corpus(spark, str(tmp_path)).collect()
    assert counts == {"read": 204, "written": 199} and {r.doc_id for r in rows} == set(range(200)) - {7}  # 7 has labels that contradict each other
    assert {r["class"] for r in rows} == {f"{a}/toxic={t}" for a in ("en", "de", "none") for t in (0, 1)}
    side = defaultdict(set)
    for r in rows:
        side[r["class"], r.text].add(r.split)
    assert all(len(s) == 1 for s in side.values())
    for c in {r["class"] for r in rows}:
        n = Counter(next(iter(s)) for (k, _), s in side.items() if k == c)
        total = sum(n.values())
        assert n["train"] == math.floor(total * 0.6) and n["train"] + n["validation"] == math.floor(total * 0.8)
    assert run() == counts and sorted(labelled_split.read_corpus(spark, str(tmp_path)).collect()) == sorted(rows)
    report = spark.read.json(f"{tmp_path}/report").collect()
    assert sum(r.documents for r in report) == 199 and "wrote 199 with labels" in caplog.text
    assert sorted(p.name for p in (tmp_path / "corpus").iterdir() if p.is_dir()) == ["split=test", "split=train", "split=validation"]


def test_split_of_nothing_and_bad_shares(spark, corpus, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels")
    assert labelled_split.build(spark, f"{corpus}/documents", f"{tmp_path}/labels", f"{tmp_path}/out") == {"read": 204, "written": 0}
    assert labelled_split.read_corpus(spark, f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError):
        labelled_split.build(spark, f"{corpus}/documents", f"{corpus}/labels", f"{tmp_path}/out", labelled_split.Settings(shares={"a": 0.5}))


def test_command_line_reads_its_configuration(spark, corpus, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"min_words": 2, "shares": {"all": 1.0}}))
    monkeypatch.setattr("lacuna.session.build_session", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    common.main("labelled_split", {"documents": "", "labels": "", "output": ""}, labelled_split.build, labelled_split.Settings,
                ["--documents", f"{corpus}/documents", "--labels", f"{corpus}/labels", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json"])
    assert {r.split for r in labelled_split.read_corpus(spark, f"{tmp_path}/out").collect()} == {"all"}
    (tmp_path / "c.json").write_text(json.dumps({"min_word": 2}))
    with pytest.raises(ValueError, match="unknown settings"):
        common.configured(spark, labelled_split.Settings, f"{tmp_path}/c.json")
    for job, kind in (("light_curves", light_curves.Settings), ("labelled_split", labelled_split.Settings)):
        assert common.configured(spark, kind, f"jobs/{job}.json")
