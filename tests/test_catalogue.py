"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

from lacuna.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalogue.oracle_sql()
#: A few of each family; the driver runs them all.
SOME = ["impute_linear_rmse", "impute_knn", "gap_runs", "sigma_clip", "truncate_densest", "metric_pointwise", "wilcoxon", "friedman", "lomb_scargle", "features_35", "clf_metrics", "signal_eclipsing"]


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
