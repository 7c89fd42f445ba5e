"""Streams driven into files over a small folder: restarts, late rows, timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lacuna import streaming
from lacuna.operators import classify

T0 = dt.datetime(2024, 1, 1)


def put(spark, rows, path):
    spark.createDataFrame(rows, streaming.EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def hourly(ids):
    return [(i, T0 + dt.timedelta(hours=i), i % 2, "view", float(i), None) for i in ids]


def test_carry_forward_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def run():
        e = streaming.read_events(spark, str(src), glob="*.parquet").withColumn("obs", F.when(F.col("event_id") % 6 < 2, F.col("value")))
        return streaming.run_to_files(streaming.carry_forward(e, late=5 * 3600), out, mark, partition_by=("late",))

    put(spark, hourly(range(15)), src)
    assert run().count() == 15
    put(spark, [*hourly(range(15, 30)), (100, T0, 0, "view", 7.0, None), (102, T0, 1, "view", None, None), (101, None, 1, "view", 1.0, None)], src)
    before = spark.conf.get(streaming.STORE)
    got = {r.event_id: r for r in run().collect()}
    assert spark.conf.get(streaming.STORE) == before
    assert len(got) == 32 and got[4].imputed == 0.0 and got[5].imputed == 1.0 and got[17].imputed == 13.0
    assert {i for i, r in got.items() if r.late} == {100, 102} and got[100].imputed is None and got[102].imputed is None
    once = sorted(map(tuple, got.values()))
    assert sorted(map(tuple, run().collect())) == once  # nothing new
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("late")) == ["late=false", "late=true"]


def test_windows_replace_their_files(spark, tmp_path):
    src = tmp_path / "in"
    run = lambda: streaming.run_to_files(streaming.windowed_summary(streaming.read_events(spark, str(src), glob="*.parquet")), f"{tmp_path}/out", f"{tmp_path}/mark", "complete")
    put(spark, hourly(range(20)), src)
    assert sorted((r.n, r.mean) for r in run().collect()) == [(20, 9.5)]
    put(spark, hourly(range(20, 30)), src)
    assert sorted((r.n, r.mean) for r in run().collect()) == [(6, 26.5), (24, 11.5)]


def test_gap_alarms_by_rows_and_by_timers(spark, tmp_path):
    src, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def run():
        t = streaming.run_to_files(streaming.gap_alarms(streaming.read_events(spark, str(src), glob="*.parquet"), 10 * 3600, "1 hour"), out, mark)
        return sorted(((r.user_id, r.start.hour, r.end and r.end.hour) for r in t.collect()), key=str)

    put(spark, [(1, T0, 1, "view", 1.0, None), (2, T0 + dt.timedelta(hours=12), 1, "view", 1.0, None), (3, T0 + dt.timedelta(hours=1), 2, "view", 1.0, None), (4, None, 2, "view", 1.0, None)], src)
    # the second user's silence of ten hours ends as an alarm when the watermark, an hour behind 12:00, has passed 11:00
    assert run() == [(1, 0, 12), (2, 1, None)]
    put(spark, [(5, T0 + dt.timedelta(hours=15), 1, "view", 1.0, None), (6, T0 + dt.timedelta(hours=16), 2, "view", 1.0, None)], src)
    assert run() == [(1, 0, 12), (2, 1, None)]
    put(spark, [(7, T0 + dt.timedelta(hours=40), 3, "view", 1.0, None)], src)
    assert run() == [(1, 0, 12), (1, 15, None), (2, 1, None), (2, 16, None)]


def test_forest_round_trip(spark, tmp_path):
    rows = [(i, float(i % 3), float(i % 3) + 0.01 * (i % 7), float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "series_id long, label double, x double, z double")
    model, scores = classify.train_forest(df, ["x", "z"], trees=20, depth=6, folds=3, path=str(tmp_path / "m"))
    assert len(scores) == 3 and min(scores) > 0.6
    again = classify.load_classifier(str(tmp_path / "m")).transform(df.withColumn("weight", F.lit(1.0)))
    s = classify.scores(again).first()
    assert s.accuracy > 0.95 and s.macro_f1 > 0.95 and s.mcc > 0.9
    assert classify.importance(model, ["x", "z"])[0][0] == "x"


def test_rbf_machine_scores_unseen_rows_after_a_reload(spark, tmp_path):
    """Rings can't be told apart by a line; the frozen machine scales new rows by what it was fitted on."""
    import math
    import random

    rng = random.Random(4)

    def ring(i):
        r, a = (1.0 if i % 2 else 3.0) + rng.gauss(0, 0.15), rng.uniform(0, 2 * math.pi)
        return i, float(i % 2), 100 + 10 * r * math.cos(a), r * math.sin(a), 5.0

    rows = [ring(i) for i in range(400)] + [(1000, 1.0, None, 0.1, None)]
    df = spark.createDataFrame(rows, "series_id long, label double, x double, y double, flat double")
    classify.train_svm(df.where("series_id < 300 OR series_id = 1000"), ["x", "y", "flat"], n=128, path=str(tmp_path / "m"))
    machine = classify.load_classifier(str(tmp_path / "m"))
    unseen = df.where("series_id BETWEEN 300 AND 399")
    assert classify.scores(machine.transform(unseen)).first().accuracy > 0.9
    one = machine.transform(unseen.where("series_id = 311")).first()  # alone it is scaled as among others
    assert one.prediction == next(r for r in machine.transform(unseen).collect() if r.series_id == 311).prediction
    assert machine.transform(df.where("series_id = 1000")).count() == 1
    folds = classify.cross_validated(df.where("series_id < 200"), lambda x: classify.train_svm(x, ["x", "y"], n=64), folds=3).collect()
    assert [r.fold for r in folds] == [0, 1, 2] and min(r.accuracy for r in folds) > 0.8


def test_sliding_windows_take_whole_seconds_as_their_sql_does(spark, tmp_path):
    import duckdb

    from lacuna.plans import catalogue

    times = ["2024-01-03 05:59:59.7", "2024-01-03 05:59:59.4", "2024-01-03 06:00:00.5", "2024-01-09 12:00:00"]
    c = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', 1, 'click', {i}::DOUBLE, NULL::VARCHAR)" for i, t in enumerate(times))
    c.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) AS v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(c.sql(catalogue.oracle_sql()["stream_sliding"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.queries()["stream_sliding"](spark, str(tmp_path)).collect()) == want and len(want) == 5
