"""Queries over as-of joins and distributed order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators import order as ordering
from ..operators.asof import asof_join
from ..sources import series as src
from . import oracles as o
from .catalogue_series import q, r

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _events(spark, d, kind: str, prefix: str):
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind)
    return e.select(F.col("user_id"), F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))


def _side(kind: str, prefix: str) -> str:
    return f"{prefix} AS (SELECT user_id, event_id AS {prefix}_id, ts AS {prefix}_ts FROM events WHERE event_type = '{kind}')"


@query("asof_join", """WITH r AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k, max_by(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1, 2)
SELECT e.event_id, r.k AS o_orderkey, r.p AS o_totalprice FROM events e ASOF LEFT JOIN r ON e.user_id = r.o_custkey AND e.ts >= r.o_orderdate""")
def asof_orders(spark, d):
    """Each event with its user's last order."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return asof_join(e, orders, "ts", "o_orderdate", [("user_id", "o_custkey")], tie=["o_orderkey"]).select("event_id", "o_orderkey", "o_totalprice")


@query("asof_within", f"""WITH {_side('purchase', 'p')}, {_side('view', 'v')}
SELECT p_id, CASE WHEN epoch_us(p_ts) - epoch_us(v_ts) <= 86400000000 THEN v_id END AS v_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p_ts >= v_ts""")
def asof_within(spark, d):
    """Each purchase with the user's last view of the day before it."""
    return asof_join(_events(spark, d, "purchase", "p"), _events(spark, d, "view", "v"), "p_ts", "v_ts", ["user_id"], tolerance=86400).select("p_id", "v_id")


@query("asof_forward", """WITH r AS (SELECT l_orderkey, l_shipdate, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, r.l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders ASOF JOIN r ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate""")
def asof_forward(spark, d):
    """Each order with its next shipment."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_linenumber")
    j = asof_join(orders, items, "o_orderdate", "l_shipdate", [("o_orderkey", "l_orderkey")], "forward", tie=["l_linenumber"], how="inner")
    return j.select("o_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("asof_nearest", f"""WITH {_side('error', 'e')}, {_side('click', 'c')},
b AS (SELECT e_id, c_id, epoch_us(e_ts) - epoch_us(c_ts) AS away FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e_ts >= c_ts),
f AS (SELECT e_id, c_id, epoch_us(c_ts) - epoch_us(e_ts) AS away FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e_ts <= c_ts)
SELECT e_id, CASE WHEN b.away IS NULL OR f.away < b.away THEN f.c_id ELSE b.c_id END AS c_id FROM b JOIN f USING (e_id)""")
def asof_nearest(spark, d):
    """Each error with the user's nearest click, before or after."""
    return asof_join(_events(spark, d, "error", "e"), _events(spark, d, "click", "c"), "e_ts", "c_ts", ["user_id"], "nearest").select("e_id", "c_id")


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("flux_quantiles", f"WITH {o.ES} SELECT label, count(flux) AS n, " + ", ".join(f"{q(f'quantile_cont(flux, {p})')} AS q{round(100 * p)}" for p in SHARES) + " FROM es GROUP BY label")
def flux_quantiles(spark, d):
    x = ordering.quantiles(src.events_series(spark, d), "flux", SHARES, ("label",))
    return x.select("label", "n", *[r(F.col("q")[i]).alias(f"q{round(100 * p)}") for i, p in enumerate(SHARES)])


@query("flux_ranks", f"WITH {o.ES} SELECT event_id, rank() OVER (PARTITION BY label ORDER BY flux) AS rank, count(*) OVER (PARTITION BY label, flux) AS ties, count(*) OVER (PARTITION BY label) AS n FROM es")
def flux_ranks(spark, d):
    return ordering.with_ranks(src.events_series(spark, d).select("event_id", "label", "flux"), ["label"], ["flux"]).select("event_id", "rank", "ties", "n")


@query("flux_density", f"""WITH {o.ES}, h AS (SELECT label, least(floor(flux / 1.0), 99)::INTEGER AS b, count(*) AS n FROM es WHERE flux BETWEEN 0 AND 100 GROUP BY ALL),
t AS (SELECT label, sum(n) AS total FROM h GROUP BY label),
d AS (SELECT label, k AS bin, sum(CASE WHEN k = b THEN n ELSE 0 END) AS n, sum(n * exp(-pow((k - b) / 2.0, 2) / 2) / (2 * sqrt(2 * pi()))) AS d FROM h, unnest(range(greatest(0, b - 8), least(99, b + 8) + 1)) AS u(k) GROUP BY ALL)
SELECT label, bin::INTEGER AS bin, bin + 0.5::DOUBLE AS x, n::BIGINT AS n, {q('d / total', 8)} AS density FROM d JOIN t USING (label)""")
def flux_density(spark, d):
    """The curves of a violin plot of the flux by class."""
    x = metrics.density(src.events_series(spark, d), "flux", 0.0, 100.0, 100, 2.0, ("label",))
    return x.withColumn("density", r("density", 8))
