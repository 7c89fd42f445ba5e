"""SQL fragments that DuckDB runs on the same tables."""

ES = """es AS (SELECT user_id AS series_id, event_id, epoch_us(ts)::DOUBLE / 86400e6 - 19723.0 AS t, value AS flux, event_type AS label FROM events)"""
G = ES + """,
g AS (SELECT es.*, (m / 1000.0)::DOUBLE AS fraction, (event_id * 2654435761) % 1000 < m AS is_missing,
        CASE WHEN NOT (event_id * 2654435761) % 1000 < m THEN flux END AS obs, flux AS truth
      FROM es, (VALUES (100), (300), (500)) AS f(m))"""
W = "PARTITION BY series_id, fraction ORDER BY t, event_id"
UP, DOWN, ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
MEAN = "coalesce(obs, avg(obs) OVER (PARTITION BY series_id, fraction))"
FFILL = f"coalesce(last_value(obs IGNORE NULLS) OVER ({W} {UP}), first_value(obs IGNORE NULLS) OVER ({W} {DOWN}))"


def linear(ends: str = "extrapolate", x: str = "t", source: str = "g") -> str:
    """CTEs ending in ``lin``: source plus ``imputed``."""
    back = "PARTITION BY series_id, fraction ORDER BY t DESC, event_id DESC"
    low, high = ("fb", "fa") if ends == "clamp" else (
        "fb + (x - xb) / nullif(x2 - xb, 0) * (f2 - fb)", "f9 + (x - x9) / nullif(xa - x9, 0) * (fa - f9)")
    return f"""
lx AS (SELECT *, {x} AS x FROM {source}),
lp AS (SELECT *, CASE WHEN obs IS NOT NULL THEN x END AS px FROM lx),
ln AS (SELECT *,
  last_value(px IGNORE NULLS) OVER ({W} {UP}) AS xa, last_value(obs IGNORE NULLS) OVER ({W} {UP}) AS fa,
  first_value(px IGNORE NULLS) OVER ({W} {DOWN}) AS xb, first_value(obs IGNORE NULLS) OVER ({W} {DOWN}) AS fb,
  nth_value(px, 2 IGNORE NULLS) OVER ({W} {ALL}) AS x2, nth_value(obs, 2 IGNORE NULLS) OVER ({W} {ALL}) AS f2,
  nth_value(px, 2 IGNORE NULLS) OVER ({back} {ALL}) AS x9, nth_value(obs, 2 IGNORE NULLS) OVER ({back} {ALL}) AS f9,
  avg(obs) OVER (PARTITION BY series_id, fraction) AS mu FROM lp),
lin AS (SELECT *, coalesce(obs, CASE WHEN xa IS NULL THEN {low} WHEN xb IS NULL THEN {high}
    ELSE coalesce(fa + (x - xa) / nullif(xb - xa, 0) * (fb - fa), fa) END, mu) AS imputed FROM ln)"""


IMPS = G + "," + linear() + f""",
im AS (SELECT 'Linear-Interp' AS method, series_id, fraction, t, event_id, is_missing, truth, imputed FROM lin
  UNION ALL SELECT 'Mean-Fill', series_id, fraction, t, event_id, is_missing, truth, {MEAN} FROM g
  UNION ALL SELECT 'Forward-Fill', series_id, fraction, t, event_id, is_missing, truth, {FFILL} FROM g)"""
RAW = IMPS + """,
raw AS (SELECT method, fraction, series_id AS seed, count(*) AS n, sqrt(avg(pow(imputed - truth, 2))) AS rmse, avg(abs(imputed - truth)) AS mae,
    avg(pow(imputed - truth, 2)) AS mse, avg(abs(imputed - truth) / (abs(truth) + 1e-8)) AS relative_error
  FROM im WHERE is_missing GROUP BY ALL)"""


def lomb_scargle(source: str, keys: str, grid: str, value: str = "flux", out: str = "sp") -> str:
    """CTE ``out``: (keys, k, freq, power). ``grid``: a select of keys, fmin, df, nf."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{out}_g AS ({grid}),
{out}_p AS (SELECT {own}, k, b.fmin + k * b.df AS freq, a.{value} AS y, cos(2 * pi() * (b.fmin + k * b.df) * a.t) AS c, sin(2 * pi() * (b.fmin + k * b.df) * a.t) AS s
  FROM {source} a JOIN {out}_g b ON {on}, unnest(range(0, b.nf)) AS u(k) WHERE a.{value} IS NOT NULL),
{out}_a AS (SELECT {keys}, k, min(freq) AS freq, avg(y) AS y, avg(y * y) AS yy, avg(c) AS c, avg(s) AS s, avg(y * c) AS yc, avg(y * s) AS ys, avg(c * c) AS cc, avg(s * s) AS ss, avg(c * s) AS cs
  FROM {out}_p GROUP BY {keys}, k),
{out}_m AS (SELECT {keys}, k, freq, yy - y * y AS vy, yc - y * c AS vyc, ys - y * s AS vys, cc - c * c AS vc, ss - s * s AS vs, cs - c * s AS vcs FROM {out}_a),
{out} AS (SELECT {keys}, k, freq, (vs * vyc * vyc + vc * vys * vys - 2 * vcs * vyc * vys)
    / CASE WHEN abs(vy) > 1e-300 AND abs(vc * vs - vcs * vcs) > 1e-300 THEN vy * (vc * vs - vcs * vcs) END AS power FROM {out}_m)"""


def peak(source: str, keys: str, out: str = "pk") -> str:
    return f"""
{out} AS (SELECT {keys}, freq, 1 / freq AS period, power FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(power, 12) DESC, k) AS rn FROM {source} WHERE power IS NOT NULL) WHERE rn = 1)"""
