"""Queries that run chains: one row for each number that a verb gives, and the SQL that it must equal."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import chain
from tessera.plans._queries import Registry, t

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def numbers(verb: str, value) -> list[tuple[str, str, int, float | None]]:
    """(verb, name, place, value) of a result."""
    if isinstance(value, dict):
        return [(verb, k, 0, float(v)) for k, v in value.items() if not isinstance(v, (str, dict))]
    if isinstance(value, (list, tuple, np.ndarray)):
        return [(verb, "", i, float(v)) for i, v in enumerate(np.asarray(value, float).ravel())]
    return [(verb, "", 0, float(value))]


def rows(spark, df, text: str, order: list[str] | None = None, columns: list[str] | None = None, places: int = 6):
    found = [x for verb, value in chain.run(df, text, columns, order).outputs if value is not None for x in numbers(verb, value)]
    # an infinite number is NULL on both sides
    found = [(a, b, c, None if v is None or not math.isfinite(v) else round(v, places) + 0.0) for a, b, c, v in found]
    return spark.createDataFrame(found, "verb string, name string, place long, value double")


def union(parts: list[tuple[str, str, str]], source: str, places: int = 6) -> str:
    """SQL of (verb, name, expression) over a source."""
    return "WITH src AS MATERIALIZED (" + source + ") " + " UNION ALL ".join(f"SELECT '{v}' AS verb, '{n}' AS name, 0::BIGINT AS place, round(({e})::DOUBLE, {places}) + 0.0 AS value" for v, n, e in parts)


_AGG = lambda e: f"SELECT {e} FROM src"
_DESCRIPTIVE = [
    ("mean", "", _AGG("avg(x)")), ("std", "", _AGG("stddev_samp(x)")), ("variance", "", _AGG("var_samp(x)")), ("skewness", "", _AGG("skewness(x)")), ("kurtosis", "", _AGG("kurtosis(x)")),
    ("sem", "", _AGG("stddev_samp(x) / sqrt(count(x))")), ("cv", "", _AGG("stddev_samp(x) / abs(avg(x))")), ("median", "", _AGG("median(x)")), ("quantile", "", _AGG("quantile_cont(x, 0.9)")),
    ("iqr", "", _AGG("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")), ("mad", "", "SELECT median(abs(x - (SELECT median(x) FROM src))) FROM src"),
    ("geometric_mean", "", _AGG("exp(avg(ln(x)))")), ("harmonic_mean", "", _AGG("count(x) / sum(1 / x)")), ("percentileofscore", "", _AGG("100.0 * count(*) FILTER (x <= 20) / count(*)")),
    ("mode", "", "SELECT x FROM src GROUP BY x ORDER BY count(*) DESC, x LIMIT 1"), ("realized_variance", "", _AGG("sum(x * x)")), ("realized_volatility", "", _AGG("sqrt(sum(x * x))")),
    ("zero_crossing_rate", "", "SELECT 0.0"), ("sign_test", "statistic", _AGG("count(*) FILTER (x > 20)")), ("cesaro_sum", "", "SELECT avg(s) FROM (SELECT sum(x) OVER (ORDER BY i) AS s FROM src)"),
    ("entropy", "", "WITH b AS (SELECT least(floor((x - lo) / w), 9) AS b, w FROM src, (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM src)), c AS (SELECT b, count(*) / (SELECT count(*) FROM src) AS p, any_value(w) AS w FROM b GROUP BY b) SELECT -sum(p * ln(p)) + ln(any_value(w)) FROM c"),
    ("harmonic_r_stat", "", "WITH g AS (SELECT i, x - lag(x) OVER (ORDER BY x, i) AS g FROM src), h AS (SELECT g, lag(g) OVER (ORDER BY x, i) AS f FROM (SELECT g.*, src.x FROM g JOIN src USING (i))) SELECT avg(least(g, f) / greatest(g, f)) FROM h WHERE f IS NOT NULL AND greatest(g, f) >= 1e-30"),
]


@query(union(_DESCRIPTIVE, "SELECT o_orderkey AS i, o_totalprice / 10000 + 1 AS x FROM orders", 5))
def chain_descriptive(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000 + 1).alias("x"))
    text = (
        "mean().std().variance().skewness().kurtosis().sem().cv().median().quantile(q=0.9).iqr().mad().geometric_mean().harmonic_mean().percentileofscore(score=20).mode()"
        ".realized_variance().realized_volatility().zero_crossing_rate().sign_test(median=20).cesaro_sum().entropy().harmonic_r_stat()"
    )
    out = rows(spark, df, text, ["o_orderkey"], ["x"], 5)
    return out.filter("NOT (verb = 'sign_test' AND name = 'p')")


_K = "(SELECT i, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM (SELECT i, x AS v, 0 AS g FROM src UNION ALL SELECT i, y, 1 FROM src))"
_U = f"(SELECT sum(k) - count(*) * (count(*) + 1) / 2 FROM {_K} WHERE g = 0)"
_TAU = "SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum((a.x <> b.x)::INT) * sum((a.y <> b.y)::INT)::DOUBLE) FROM src a JOIN src b ON a.i < b.i"
_BIN = "least(floor((%s - lo_%s) / (hi_%s - lo_%s) * 9 + 0.5), 9)"
_TWO = [
    ("pearson_r", "", _AGG("corr(x, y)")),
    ("spearman", "", "SELECT corr(p, q) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS q FROM src)"),
    ("kendall", "", _TAU),
    ("concordance_correlation", "", _AGG("2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) ^ 2)")),
    ("ols_simple", "slope", _AGG("regr_slope(y, x)")), ("ols_simple", "intercept", _AGG("regr_intercept(y, x)")), ("ols_simple", "r2", _AGG("regr_r2(y, x)")),
    ("cohens_d", "", _AGG("(avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2)")), ("hedges_g", "", _AGG("(avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2) * (1 - 3 / (4 * (2 * count(*) - 2) - 1))")),
    ("welch_t", "statistic", _AGG("(avg(x) - avg(y)) / sqrt(var_samp(x) / count(*) + var_samp(y) / count(*))")), ("paired_t", "statistic", _AGG("avg(x - y) / (stddev_samp(x - y) / sqrt(count(*)))")),
    ("rank_biserial", "", f"SELECT 1 - 2 * least({_U}, n * n - {_U}) / (n * n) FROM (SELECT count(*)::DOUBLE AS n FROM src)"),
    ("ranksums", "statistic", f"SELECT ((SELECT sum(k) FROM {_K} WHERE g = 0) - n * (2 * n + 1) / 2) / sqrt(n * n * (2 * n + 1) / 12) FROM (SELECT count(*)::DOUBLE AS n FROM src)"),
    ("energy_distance", "", "SELECT 2 * avg(abs(a.x - b.y)) - avg(abs(a.x - b.x)) - avg(abs(a.y - b.y)) FROM src a, src b"),
    ("wasserstein_1d", "", "SELECT avg(abs(x - y)) FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM src) JOIN (SELECT y, row_number() OVER (ORDER BY y) AS r FROM src) USING (r)"),
    ("joint_entropy", "", f"WITH m AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM src), c AS (SELECT count(*) / (SELECT count(*) FROM src) AS p FROM src, m GROUP BY {_BIN % (('x',) * 4)}, {_BIN % (('y',) * 4)}) SELECT -sum(p * ln(p)) FROM c"),
    ("distance_correlation", "", "WITH d AS (SELECT a.i, b.i AS j, abs(a.x - b.x) AS x, abs(a.y - b.y) AS y FROM src a, src b), c AS (SELECT x - avg(x) OVER (PARTITION BY i) - avg(x) OVER (PARTITION BY j) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY i) - avg(y) OVER (PARTITION BY j) + avg(y) OVER () AS y FROM d) SELECT sqrt(avg(x * y) / sqrt(avg(x * x) * avg(y * y))) FROM c"),
    ("theilslopes", "slope", "SELECT median((b.y - a.y) / (b.x - a.x)) FROM src a JOIN src b ON a.i < b.i AND a.x <> b.x"),
]


@query(union(_TWO, "SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey / 5.0 + s_acctbal / 3000 AS y FROM supplier"))
def chain_two_columns(spark, sf_dir):
    df = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0 + F.col("s_acctbal") / 3000).alias("y"))
    text = (
        "pearson_r().spearman().kendall().concordance_correlation().ols_simple().cohens_d().hedges_g().welch_t().paired_t().rank_biserial().ranksums().energy_distance()"
        ".wasserstein_1d().joint_entropy().distance_correlation().theilslopes()"
    )
    out = rows(spark, df, text, ["s_suppkey"], ["x", "y"])
    return out.filter("name NOT IN ('p', 'df') AND NOT (verb = 'theilslopes' AND name = 'intercept')")


@query("""WITH p AS (SELECT n_nationkey AS k, (n_nationkey + 1) * (n_nationkey + 2) / 2000.0 AS p FROM nation), s AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p),
h AS (SELECT *, max(p * (m - r + 1)) OVER (ORDER BY r) AS hp, min(p * m / r) OVER (ORDER BY r DESC) AS bp FROM s)
SELECT verb, '' AS name, k::BIGINT AS place, round(least(value, 1.0), 9) + 0.0 AS value FROM (SELECT k, 'bonferroni' AS verb, p * m AS value FROM h UNION ALL SELECT k, 'holm', hp FROM h UNION ALL SELECT k, 'benjamini_hochberg', bp FROM h)""")
def chain_corrections(spark, sf_dir):
    df = t(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 2) / 2000.0).alias("p"))
    return rows(spark, df, "bonferroni().holm().benjamini_hochberg()", ["n_nationkey"], ["p"], 9)


_EDGES = "(SELECT DISTINCT c_nationkey % 12 AS src, (s_nationkey * 7 + 3) % 14 AS dst, (c_nationkey + s_nationkey) % 9 + 1 AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey < s_nationkey)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, min(w)::DOUBLE AS w FROM {_EDGES} GROUP BY 1, 2),
r(k, node, d) AS (SELECT 0, 0, 0.0::DOUBLE UNION ALL SELECT k + 1, dst, min(d + w) FROM r JOIN e ON node = src WHERE k < 14 GROUP BY k, dst),
b(k, node) AS (SELECT 0, 0 UNION SELECT k + 1, dst FROM b JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) u ON node = u.src WHERE k < 14),
f(k, i, j, d) AS (SELECT 0, x.i, y.j, least(CASE WHEN x.i = y.j THEN 0 END, (SELECT w FROM e WHERE src = x.i AND dst = y.j)) FROM range(14) x(i), range(14) y(j)
 UNION ALL SELECT f.k + 1, f.i, f.j, least(f.d, g.d + h.d) FROM f JOIN f g ON g.i = f.i AND g.j = f.k JOIN f h ON h.i = f.k AND h.j = f.j WHERE f.k < 14)
SELECT verb, '' AS name, place::BIGINT AS place, round(value, 6) AS value FROM (
 SELECT v.verb, n AS place, d AS value FROM range(14) x(n) CROSS JOIN (VALUES ('dijkstra'), ('bellman_ford')) v(verb) LEFT JOIN (SELECT node, min(d) AS d FROM r GROUP BY 1) ON node = n
 UNION ALL SELECT 'bfs', n, k FROM range(14) x(n) LEFT JOIN (SELECT node, min(k) AS k FROM b GROUP BY 1) ON node = n
 UNION ALL SELECT 'floyd_warshall', i * 14 + j, d FROM f WHERE k = 14
 UNION ALL SELECT 'degree_centrality', n, coalesce(k, 0) / 13 FROM range(14) x(n) LEFT JOIN (SELECT src, count(*) AS k FROM {_EDGES} GROUP BY 1) ON src = n)""")
def chain_graph(spark, sf_dir):
    o, c, li, s = (t(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier"))
    e = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey < s_nationkey")
    a, b = F.col("c_nationkey"), F.col("s_nationkey")
    df = e.select((a % 12).alias("src"), ((b * 7 + 3) % 14).alias("dst"), ((a + b) % 9 + 1).alias("w")).distinct()
    return rows(spark, df, "dijkstra(n_nodes=14).bellman_ford(n_nodes=14).bfs(n_nodes=14).floyd_warshall(n_nodes=14).degree_centrality(n_nodes=14)", None, ["src", "dst", "w"])


_X = "(SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value AS x FROM events WHERE user_id = (SELECT min(user_id) FROM events))"


@query(f"""WITH RECURSIVE src AS MATERIALIZED (SELECT i, x FROM {_X}),
q(i, ema, v, m, p) AS (SELECT i, x, (SELECT avg(x * x) FROM src), x / 2, 0.5::DOUBLE FROM src WHERE i = 1
 UNION ALL SELECT s.i, 0.1 * s.x + 0.9 * q.ema, 0.94 * q.v + 0.06 * o.x * o.x, q.m + (q.p + 1) / (q.p + 2) * (s.x - q.m), (1 - (q.p + 1) / (q.p + 2)) * (q.p + 1) FROM q JOIN src s ON s.i = q.i + 1 JOIN src o ON o.i = q.i)
SELECT verb, '' AS name, place::BIGINT AS place, round(value, 5) + 0.0 AS value FROM (
 SELECT 'ema' AS verb, i - 1 AS place, ema AS value FROM q UNION ALL SELECT 'ewma_var', i - 1, v FROM q UNION ALL SELECT 'kalman_scalar', i - 1, m FROM q
 UNION ALL SELECT 'moving_average', i - 1, avg(x) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) FROM src
 UNION ALL SELECT 'median_filter', i - 1, median(x) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) FROM src
 UNION ALL SELECT 'difference', i - 2, d FROM (SELECT i, x - lag(x) OVER (ORDER BY i) AS d FROM src) WHERE i > 1
 UNION ALL SELECT 'acf', k, (SELECT sum(a.d * b.d) FROM c a JOIN c b ON b.i = a.i + k) / (SELECT sum(d * d) FROM c) FROM range(6) l(k), (SELECT 1) CROSS JOIN (SELECT 1) WHERE k >= 0
)""".replace("range(6) l(k), (SELECT 1) CROSS JOIN (SELECT 1) WHERE k >= 0", "range(6) l(k)").replace("q(i, ema", "c AS (SELECT i, x - avg(x) OVER () AS d FROM src), q(i, ema"))
def chain_series(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    first = e.agg(F.min("user_id")).first()[0]
    df = e.filter(F.col("user_id") == first).select("ts", "event_id", F.col("value").alias("x"))
    return rows(spark, df, "ema().ewma_var().kalman_scalar().moving_average().median_filter().difference().acf(max_lag=5)", ["ts", "event_id"], ["x"], 5)


@query("""SELECT 'gcd' AS verb, '' AS name, 0::BIGINT AS place, gcd(84, 36)::DOUBLE AS value UNION ALL SELECT 'lcm', '', 0, lcm(84, 36)
UNION ALL SELECT 'is_prime', '', 0, (SELECT (count(*) = 0)::INT FROM range(2, 97) d(d) WHERE 97 % d = 0) UNION ALL SELECT 'euler_totient', '', 0, (SELECT count(*) FROM range(1, 61) d(d) WHERE gcd(d, 60) = 1)
UNION ALL SELECT 'black_body', '', 0, round(5.670374419e-8 * 300.0 ^ 4, 6) UNION ALL SELECT 'carnot_efficiency', '', 0, 0.4 UNION ALL SELECT 'ideal_gas_pressure', '', 0, round(2 * 8.314462618 * 300 / 0.5, 6)
UNION ALL SELECT 'sho', '', 0, round(1.5 * cos(2 * 0.7) + 0.5 / 2 * sin(2 * 0.7), 6) UNION ALL SELECT 'sho', '', 1, round(0.5 * cos(2 * 0.7) - 1.5 * 2 * sin(2 * 0.7), 6)""")
def chain_formulas(spark, sf_dir):
    text = "gcd(a=84, b=36).lcm(a=84, b=36).is_prime(n=97).euler_totient(n=60).black_body(temperature=300).carnot_efficiency(t_hot=500, t_cold=300).ideal_gas_pressure(n_mol=2, temperature=300, volume=0.5).sho(x0=1.5, v0=0.5, omega=2, t=0.7)"
    return rows(spark, t(spark, sf_dir, "region"), text)


@query("""WITH src AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y, s_acctbal * s_nationkey / 10000 AS v FROM supplier), z AS (SELECT *, v - avg(v) OVER () AS d FROM src),
k AS (SELECT a.d AS a, b.d AS b FROM z a JOIN z b ON a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2, b.i) <= 4),
n AS (SELECT count(*) AS n, sum(d * d) AS t FROM z), c AS (SELECT count(*) AS w, sum(a * b) AS ab, sum((a - b) ^ 2) AS g FROM k)
SELECT 'morans_i' AS verb, '' AS name, 0::BIGINT AS place, round(n / w * ab / t, 6) AS value FROM n, c UNION ALL SELECT 'gearys_c', '', 0, round((n - 1) * g / (2 * w * t), 6) FROM n, c""")
def chain_spatial(spark, sf_dir):
    df = t(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_acctbal") * F.col("s_nationkey") / 10000).alias("v"))
    return rows(spark, df, "morans_i().gearys_c()")


@query("""WITH x AS (SELECT datediff('day', o_orderdate, l_shipdate) AS t, (l_returnflag = 'R')::INT AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT t, count(*) AS n, sum(e) AS d FROM x GROUP BY 1),
r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS risk FROM c), s AS (SELECT t, d, exp(sum(ln(nullif(1 - d / risk, 0))) OVER (ORDER BY t)) AS s FROM r)
SELECT 'kaplan_meier' AS verb, '' AS name, 0::BIGINT AS place, (SELECT min(t)::DOUBLE FROM s WHERE d > 0 AND coalesce(s, 0) <= 0.5) AS value""")
def chain_survival(spark, sf_dir):
    j = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = j.select(F.datediff("l_shipdate", "o_orderdate").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"))
    return rows(spark, df, "kaplan_meier()")


@query("""WITH p AS (SELECT x, y FROM (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY 1) WHERE x <= 6), l AS (SELECT a.x AS xa, any_value(a.y) AS ya, product((3.5 - b.x) / (a.x - b.x)) AS w FROM p a JOIN p b ON a.x <> b.x GROUP BY 1)
SELECT verb, '' AS name, 0::BIGINT AS place, round(value, 5) AS value FROM (SELECT 'lagrange' AS verb, (SELECT sum(ya * w) FROM l) AS value UNION ALL SELECT 'newton_interp', (SELECT sum(ya * w) FROM l)
UNION ALL SELECT 'lerp', (SELECT avg(y) FROM p WHERE x IN (3, 4)))""")
def chain_interpolation(spark, sf_dir):
    df = t(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y")).filter("x <= 6")
    return rows(spark, df, "lagrange(x=3.5).newton_interp(x=3.5).lerp(x=3.5)", ["x"], ["x", "y"], 5)
