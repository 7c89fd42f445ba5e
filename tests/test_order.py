"""Distributed ranks and as-of joins against plain Python, with hot groups cut into buckets."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lacuna.operators import asof, metrics, order, prep, stats

HOT = {"rows": 20, "buckets": 8}


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.05 else 7.5 if rng.random() < 0.3 else round(rng.gauss(0, 10), 1), i) for i, g in enumerate(["a"] * 300 + ["b"] * 9 + [None] * 40)] + [("z", None, -1)]
    return rows, spark.createDataFrame(rows, "g string, v double, id long").repartition(5).cache()


@pytest.mark.parametrize("options", [{}, HOT, {"span": (-40, 40), "buckets": 16}])
def test_ranks(values, options):
    rows, df = values
    got = order.with_ranks(df, ["g"], ["v"], **options).collect()
    assert len(got) == len(rows)
    for r in got:
        group = [v for g, v, _ in rows if g == r.g]
        low = lambda x: -math.inf if x is None else x
        assert r.n == len(group) and r["rank"] == 1 + sum(low(v) < low(r.v) for v in group) and r.ties == sum(v == r.v for v in group)


@pytest.mark.parametrize("options", [{}, HOT])
def test_quantiles_trimmed_means_and_boxes(values, options):
    rows, df = values
    q = {r.g: r for r in order.quantiles(df, "v", (0, 0.25, 0.5, 0.9, 1), ["g"], **options).collect()}
    t = {r.g: r for r in order.trimmed_mean(df, "v", 0.1, ["g"], **options).collect()}
    box = {r.g: r for r in metrics.boxplot(df, "v", ("g",), **options).collect()}
    about = {r.g: r for r in metrics.describe(df, "v", ("g",), **options).collect()}
    assert set(q) == set(t) == set(box) == {"a", "b", None} and set(about) == {"a", "b", None, "z"} and about["z"].median is None
    for g in q:
        x = sorted(v for k, v, _ in rows if k == g and v is not None)
        cut = int(0.1 * len(x))
        assert q[g].n == len(x) and q[g].q[2] == pytest.approx(statistics.median(x)) == about[g].median
        assert q[g].q[0] == x[0] and q[g].q[4] == x[-1] and q[g].q[1] == pytest.approx(statistics.quantiles(x, n=4, method="inclusive")[0])
        assert t[g].trimmed == pytest.approx(statistics.fmean(x[cut:len(x) - cut]))
        a, b = box[g].q1 - 1.5 * (box[g].q3 - box[g].q1), box[g].q3 + 1.5 * (box[g].q3 - box[g].q1)
        assert box[g].n_outliers == sum(not a <= v <= b for v in x) and box[g].whisker_high == max(v for v in x if v <= b)
    whole = order.quantiles(df, "v", (0.5,), **options).collect()
    assert [r.q[0] for r in whole] == [pytest.approx(statistics.median(v for _, v, _ in rows if v is not None))]
    assert order.quantiles(df.limit(0), "v", (0.5,), ["g"]).count() == 0


def test_splits_keep_shares_and_ids_together(spark):
    ids = [i for i in range(400)] + [17] * 200
    df = spark.createDataFrame([(i % 3 if i % 50 else None, i, 0, 0) for i in ids], "label int, event_id long, n int, rank int").repartition(3)
    got = prep.stratified_split(df, 0.3).collect()
    assert len(got) == len(ids)
    assert all(len({r.is_test for r in got if r.event_id == i}) == 1 for i in set(ids))
    for k in (0, 1, None):
        mine = [r.is_test for r in got if r.label == k]
        assert sum(mine) == math.floor(len(mine) * 0.3)
    some = prep.sample_per_class(df, 5).groupBy("label").count().collect()
    assert all(r["count"] <= 5 for r in some) and len(some) == 4
    hashed = df.select("label", F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("long").alias("h"))
    three = prep.split(hashed, {"train": 0.5, "validation": 0.2, "test": 0.3}, ["label"], "h").collect()
    assert len(three) == len(ids) and {r.split for r in three} == {"train", "validation", "test"}


def test_wilcoxon_sums_of_a_large_tied_group(spark):
    rng = random.Random(1)
    rows = [("m", 0.1, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(300)]
    got = stats.wilcoxon(spark.createDataFrame(rows, "method string, fraction double, x double, y double")).first()
    d = [x - y for _, _, x, y in rows if x != y]
    rank = lambda a: sum(abs(b) < a for b in d) + (sum(abs(b) == a for b in d) + 1) / 2
    assert got.n == len(d) and got.w_plus == pytest.approx(sum(rank(x) for x in d if x > 0)) and got.w_minus == pytest.approx(sum(rank(-x) for x in d if x < 0))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["cold", "lonely", None])
    left = [(i, key(), None if rng.random() < 0.05 else rng.randint(0, 400)) for i in range(300)]
    right = [(1000 + i, rng.choice(["hot"] * 5 + ["cold", None]), None if rng.random() < 0.05 else rng.randint(0, 400)) for i in range(150)]
    left += left[:3]
    return left, right, spark.createDataFrame(left, "id long, k string, t int").repartition(3), spark.createDataFrame(right, "rid long, k string, u int").repartition(3)


def plain(left, right, direction, exact, tolerance):
    for i, k, t in left:
        best = None
        for rid, rk, u in right:
            if None in (k, t, rk, u) or rk != k or (u == t and not exact):
                continue
            if (direction == "backward" and u > t) or (direction == "forward" and u < t) or (tolerance is not None and abs(t - u) > tolerance):
                continue
            rank = (abs(t - u), u > t, -rid)
            best = min(best or (rank, rid, u), (rank, rid, u))
        yield (i, best[1] if best else None, best[2] if best else None)


@pytest.mark.parametrize("direction,exact,tolerance,limit", [("backward", True, None, 20), ("backward", False, 9, 10**6), ("forward", True, 5, 20), ("forward", False, None, 20), ("nearest", True, 12, 20)])
def test_asof_join(sides, direction, exact, tolerance, limit):
    left, right, ldf, rdf = sides
    got = asof.asof_join(ldf, rdf, "t", "u", ["k"], direction, tolerance, exact, ["rid"], limit=limit, buckets=8)
    assert got.columns == ["id", "k", "t", "rid", "u"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.id, r.rid, r.u) for r in got.collect()), key=key) == sorted(plain(left, right, direction, exact, tolerance), key=key)


def test_asof_join_edges(spark, sides):
    _, _, ldf, rdf = sides
    assert asof.asof_join(ldf, rdf.limit(0), "t", "u", ["k"]).where("rid IS NOT NULL").count() == 0
    assert asof.asof_join(ldf, rdf.limit(0), "t", "u", ["k"], how="inner").count() == 0
    assert asof.asof_join(ldf.limit(0), rdf, "t", "u", ["k"]).count() == 0
    no_key = asof.asof_join(ldf.select("id", "t"), rdf.select("rid", "u"), "t", "u", tie=["rid"])
    assert no_key.where("u > t").count() == 0 and no_key.count() == ldf.count()
    with pytest.raises(ValueError, match="both sides"):
        asof.asof_join(ldf, rdf.withColumn("id", F.lit(1)), "t", "u", ["k"])
    with pytest.raises(ValueError):
        asof.asof_join(ldf, rdf, "t", "u", ["k"], "sideways")
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS a, 1 AS x")
    other = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS b, 2 AS y")
    assert asof.asof_join(times, other, "a", "b", tolerance=10).first().y == 2 and asof.asof_join(times, other, "a", "b", tolerance=9.5).first().y is None


def test_density_is_the_kernel_sum_of_binned_values(spark):
    rng = random.Random(8)
    rows = [("a", rng.gauss(5, 1)) for _ in range(500)] + [("b", 2.0)] * 7 + [("b", None), ("b", 99.0)]
    got = {(r.g, r.bin): r for r in metrics.density(spark.createDataFrame(rows, "g string, v double"), "v", 0.0, 10.0, 50, 0.5, ("g",)).collect()}
    middle = lambda v: (min(49, math.floor(v / 0.2)) + 0.5) * 0.2
    for g in "ab":
        x = [middle(v) for k, v in rows if k == g and v is not None and v <= 10]
        for (k, b), r in got.items():
            if k == g:
                near = [c for c in x if abs(c - r.x) <= 4 * 0.5 + 1e-9]
                assert r.density == pytest.approx(sum(math.exp(-((c - r.x) / 0.5) ** 2 / 2) for c in near) / (len(x) * 0.5 * math.sqrt(2 * math.pi)))
        assert sum(r.n for (k, _), r in got.items() if k == g) == len(x) and sum(r.density * 0.2 for (k, _), r in got.items() if k == g) == pytest.approx(1, abs=0.01)
