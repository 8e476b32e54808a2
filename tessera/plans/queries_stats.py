"""Queries of statistics, tests, models, graphs and neighbour joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import aggregates as agg
from tessera.operators import graph, hypothesis, joins, models
from tessera.operators.stages import written
from tessera.plans._queries import Registry, r, t

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_M = {
    "n": "count(v)", "mean": "avg(v)", "variance": "var_samp(v)", "std": "stddev_samp(v)", "skewness": "skewness(v)",
    "kurtosis": "kurtosis(v)", "sem": "stddev_samp(v) / sqrt(count(v))", "cv": "stddev_samp(v) / abs(avg(v))",
}


@query("SELECT l_returnflag, " + ", ".join(f"round({c}, 5) AS {n}" for n, c in _M.items()) + " FROM (SELECT l_returnflag, l_extendedprice / 1000 AS v FROM lineitem) GROUP BY 1")
def moments(spark, sf_dir):
    m = agg.moments(F.col("l_extendedprice") / 1000)
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[r(m[n], 5).alias(n) for n in _M])


@query("SELECT l_returnflag, median(l_quantity) AS median, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def quantiles(spark, sf_dir):
    q = lambda p: F.percentile("l_quantity", p)
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"), r(F.percentile("l_extendedprice", 0.9)).alias("p90"))


def _type_sql(kind: int) -> str:
    if kind == 1:
        return "SELECT user_id, 1 AS kind, round(min(x) FILTER (i >= greatest(1, ceil(0.3 * n))), 6) AS quantile FROM x GROUP BY 1"
    a, b = agg.QUANTILE_TYPES[kind]
    h = f"least(greatest(0.3 * (n + {a}) + {b}, 1.0), n)"
    return f"SELECT user_id, {kind} AS kind, round(sum(CASE WHEN i = floor({h}) THEN x * (1 - ({h} - floor({h}))) WHEN i = floor({h}) + 1 THEN x * ({h} - floor({h})) ELSE 0 END), 6) AS quantile FROM x GROUP BY 1"


@query("WITH x AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) " + " UNION ALL ".join(_type_sql(k) for k in (1, 4, 5, 6, 7, 8, 9)))
def quantile_types(spark, sf_dir):
    df, out = t(spark, sf_dir, "events"), None
    for k in (1, 4, 5, 6, 7, 8, 9):
        part = agg.quantile_of_type(df, "value", 0.3, k, "user_id").select("user_id", F.lit(k).alias("kind"), r("quantile").alias("quantile"))
        out = part if out is None else out.union(part)
    return out


@query("WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT user_id, round(median(abs(value - m)), 6) AS mad FROM events JOIN m USING (user_id) GROUP BY 1")
def median_absolute_deviation(spark, sf_dir):
    return agg.mad(t(spark, sf_dir, "events"), "value", "user_id").select("user_id", r("mad").alias("mad"))


@query("""WITH x AS (SELECT user_id, abs(value) AS x, row_number() OVER (PARTITION BY user_id ORDER BY abs(value)) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
b AS (SELECT user_id, max(x) FILTER (r = floor(n * 0.1) + 1) AS lo, max(x) FILTER (r = n - floor(n * 0.1)) AS hi FROM x GROUP BY 1)
SELECT user_id, round(CASE WHEN sum(x) = 0 THEN 0 ELSE 2 * sum(r * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n) END, 6) AS gini,
round(avg(x) FILTER (r > floor(n * 0.1) AND r <= n - floor(n * 0.1)), 6) AS trimmed_mean, round(avg(least(greatest(x, lo), hi)), 6) AS winsorized_mean,
round(avg(x), 6) AS l1, round(2 * avg(x * (r - 1) / nullif(n - 1, 0)) - avg(x), 6) AS l2,
round(6 * avg(x * (r - 1) * (r - 2) / nullif((n - 1) * (n - 2), 0)) - 6 * avg(x * (r - 1) / nullif(n - 1, 0)) + avg(x), 6) AS l3 FROM x JOIN b USING (user_id) GROUP BY 1""")
def ordered_statistics(spark, sf_dir):
    df = t(spark, sf_dir, "events").withColumn("x0", F.abs("value"))
    o = agg.ordered_stats(df, "x0", "user_id")
    return o.select("user_id", *[r(c).alias(c) for c in ("gini", "trimmed_mean", "winsorized_mean", "l1", "l2", "l3")])


@query("SELECT event_type, min(v) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS top FROM (SELECT event_type, round(value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE n = top GROUP BY 1")
def mode_value(spark, sf_dir):
    counts = t(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("event_type", F.round("value").alias("v")).agg(F.count("*").alias("n"))
    return counts.groupBy("event_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("mode"))


@query("SELECT event_type, round(100.0 * count(*) FILTER (value <= 50) / count(*), 6) AS percentile FROM events GROUP BY 1")
def percentile_of_score(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(r(100.0 * F.count_if(F.col("value") <= 50) / F.count("*")).alias("percentile"))


@query("SELECT round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 6) AS t FROM customer")
def t_test_one_sample(spark, sf_dir):
    return t(spark, sf_dir, "customer").agg(r(hypothesis.one_sample_t("c_acctbal", 4500.0)).alias("t"))


@query("""WITH s AS (SELECT count(x) AS n, count(y) AS m, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy FROM (SELECT CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS x, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS y FROM lineitem))
SELECT round((mx - my) / sqrt(vx / n + vy / m), 6) AS welch, round((vx / n + vy / m) ^ 2 / ((vx / n) ^ 2 / (n - 1) + (vy / m) ^ 2 / (m - 1)), 3) AS df, round((mx - my) / sqrt(((n - 1) * vx + (m - 1) * vy) / (n + m - 2) * (1 / n + 1 / m)), 6) AS pooled, round((mx - my) / sqrt(((n - 1) * vx + (m - 1) * vy) / (n + m - 2)), 6) AS d FROM s""")
def t_tests_two_sample(spark, sf_dir):
    g = F.col("l_returnflag") == "R"
    x = "l_extendedprice"
    return t(spark, sf_dir, "lineitem").agg(r(hypothesis.welch_t(x, g)).alias("welch"), r(hypothesis.welch_df(x, g), 3).alias("df"), r(hypothesis.pooled_t(x, g)).alias("pooled"), r(hypothesis.cohens_d(x, g)).alias("d"))


@query("SELECT round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 5) AS t FROM lineitem")
def t_test_paired(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(r(hypothesis.paired_t("l_tax", "l_discount"), 5).alias("t"))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) ^ 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM g)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS df_between, (n - k)::BIGINT AS df_within, round(b / (b + w), 6) AS eta2 FROM s""")
def anova(spark, sf_dir):
    a = hypothesis.anova(t(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment")
    return a.select(r("f", 5).alias("f"), "df_between", "df_within", r("eta2").alias("eta2"))


@query("""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), e AS (SELECT r.a, c.b, coalesce(o, 0) AS o, r * c / n AS e, n FROM (SELECT a, sum(o) AS r FROM o GROUP BY 1) r CROSS JOIN (SELECT b, sum(o) AS c FROM o GROUP BY 1) c CROSS JOIN (SELECT sum(o) AS n FROM o) LEFT JOIN o ON o.a = r.a AND o.b = c.b),
s AS (SELECT sum((o - e) ^ 2 / e) AS chi2, count(DISTINCT a) AS i, count(DISTINCT b) AS j, max(n) AS n FROM e) SELECT round(chi2, 5) AS chi2, (i - 1) * (j - 1) AS dof, round(sqrt(chi2 / (n * least(i - 1, j - 1))), 6) AS cramers_v FROM s""")
def chi_squared(spark, sf_dir):
    c = hypothesis.chi2_independence(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return c.select(r("chi2", 5).alias("chi2"), "dof", r("cramers_v").alias("cramers_v"))


@query("""WITH s AS (SELECT l_quantity AS x, l_returnflag = 'R' AS g FROM lineitem), k AS (SELECT x, g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM s), v AS (SELECT sum(t ^ 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM s GROUP BY x)),
q AS (SELECT count(*) FILTER (g)::DOUBLE AS n, count(*) FILTER (NOT g)::DOUBLE AS m, sum(r) FILTER (g) AS w FROM k), u AS (SELECT n, m, least(w - n * (n + 1) / 2, n * m - (w - n * (n + 1) / 2)) AS u FROM q)
SELECT round(u, 1) AS u, round((u - n * m / 2) / sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))), 6) AS z FROM u, v""")
def mann_whitney(spark, sf_dir):
    m = hypothesis.mann_whitney(t(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return m.select(r("u", 1).alias("u"), r("z").alias("z"))


@query("""WITH k AS (SELECT l_shipyear AS g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM (SELECT year(l_shipdate) AS l_shipyear, l_quantity AS x FROM lineitem)), v AS (SELECT sum(t ^ 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY l_quantity)),
q AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) AS k FROM (SELECT g, count(*) AS n, sum(r) AS s FROM k GROUP BY g)) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ^ 3 - n)), 5) AS h, k - 1 AS dof FROM q, v""")
def kruskal_wallis(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    return hypothesis.kruskal(df, "l_quantity", "y").select(r("h", 5).alias("h"), "dof")


@query("WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM k")
def spearman(spark, sf_dir):
    return hypothesis.spearman(t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select(r("spearman").alias("spearman"))


def _p_values(spark, sf_dir):
    return t(spark, sf_dir, "part").filter("p_size <= 50").groupBy("p_brand").agg((F.min("p_retailprice") / 100000.0).alias("p"))


_P = "(SELECT p_brand, min(p_retailprice) / 100000.0 AS p FROM part WHERE p_size <= 50 GROUP BY 1)"


@query(f"WITH x AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, p_brand) AS i FROM {_P}) SELECT p_brand, round(least(p * m, 1), 9) AS bonferroni, round(least(max(p * (m - i + 1)) OVER (ORDER BY i), 1), 9) AS holm, round(least(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS bh FROM x")
def multiple_testing(spark, sf_dir):
    x = _p_values(spark, sf_dir)
    for how in ("bonferroni", "holm", "bh"):
        x = hypothesis.adjust(x, "p", how).withColumn(how, r("adjusted", 9)).drop("adjusted")
    return x.drop("p")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple(spark, sf_dir):
    m = models.linear(t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    row = [(float(m["coefficients"][0]), float(m["intercept"]), float(m["r2"]))]
    return spark.createDataFrame(row, "slope double, intercept double, r2 double").select(r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("r2").alias("r2"))


_C = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({'any_value(1.0)' if i == j else f'corr({a}, {b})'}, 5) AS value FROM lineitem" for i, a in enumerate(_C) for j, b in enumerate(_C)))
def correlation_matrix(spark, sf_dir):
    c = models.correlation(t(spark, sf_dir, "lineitem"), _C)
    rows = [(i, j, float(c[i, j])) for i in range(len(_C)) for j in range(len(_C))]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", r("value", 5))


@query()
def pca(spark, sf_dir):
    p = models.pca(t(spark, sf_dir, "lineitem"), _C)
    rows = [(k, c, float(p["variances"][k]), float(p["axes"][i, k])) for k in range(len(_C)) for i, c in enumerate(_C)]
    return spark.createDataFrame(rows, "component int, column string, variance double, weight double")


@query("SELECT p_partkey, round((p_size - m1) / s1, 6) AS p_size, round((p_retailprice - m2) / s2, 6) AS p_retailprice FROM part, (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)")
def normalize(spark, sf_dir):
    n = models.normalized(t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return n.select("p_partkey", r("p_size").alias("p_size"), r("p_retailprice").alias("p_retailprice"))


@query("SELECT l_returnflag, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS prior, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_tax), 6) AS mean_l_tax, round(var_pop(l_quantity) + 1e-9, 5) AS var_l_quantity, round(var_pop(l_tax) + 1e-9, 8) AS var_l_tax FROM lineitem GROUP BY 1")
def naive_bayes_fit(spark, sf_dir):
    m = models.gaussian_nb(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag")
    return m.select("l_returnflag", r("prior", 9).alias("prior"), r("mean_l_quantity").alias("mean_l_quantity"), r("mean_l_tax").alias("mean_l_tax"), r("var_l_quantity", 5).alias("var_l_quantity"), r("var_l_tax", 8).alias("var_l_tax"))


@query("""WITH x AS (SELECT vec_id, label, unnest([1, 2, 3, 4]) AS j, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings), m AS (SELECT label, j, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY 1, 2),
k AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS prior FROM embeddings GROUP BY 1)
SELECT vec_id, c.label AS predicted FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM (SELECT x.vec_id, m.label, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * greatest(s, 1e-9)) - (v - m) ^ 2 / (2 * greatest(s, 1e-9))) AS score FROM x JOIN m USING (j) JOIN k ON k.label = m.label GROUP BY 1, 2)) c WHERE r = 1""")
def naive_bayes_predict(spark, sf_dir):
    df = t(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)])
    f = [f"x{i}" for i in range(4)]
    return models.gaussian_nb_predict(df, models.gaussian_nb(df, f, "label"), f, "label", "vec_id")


@query()
def logistic_regression(spark, sf_dir):
    df = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id").select(F.log1p("n_chars").alias("x"), F.col("quality").cast("double").alias("y"))
    b = models.logistic(df, ["x"], "y")
    return spark.createDataFrame([(float(b[0]), float(b[1]))], "intercept double, weight double")


@query()
def kmeans(spark, sf_dir):
    df = t(spark, sf_dir, "embeddings")
    start = [list(map(float, row.embedding)) for row in df.orderBy("vec_id").limit(4).collect()]
    return models.kmeans(df, "vec_id", "embedding", start, 20)[0].select("vec_id", F.col("label").cast("long").alias("label"), r("d2").alias("d2"))


@query()
def dbscan(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 100.0).alias("b"))
    return models.dbscan(df, "p_partkey", ["a", "b"], 0.02, 3)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2)) AS d2 FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM d)
SELECT query, rank, neighbour, round(d2, 5) AS d2 FROM k WHERE rank <= 5""")
def knn(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return joins.knn(e, e.filter("vec_id % 20 = 0"), 5).select("query", F.col("rank").cast("long").alias("rank"), "neighbour", r("d2", 5).alias("d2"))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(2 * 6371.0 * asin(sqrt(sin(radians(b.s_acctbal / 200 - a.s_acctbal / 200) / 2) ^ 2 + cos(radians(a.s_acctbal / 200)) * cos(radians(b.s_acctbal / 200)) * sin(radians(b.s_nationkey * 5 - a.s_nationkey * 5) / 2) ^ 2)), 6) AS km FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def haversine(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 200).alias("lat"), (F.col("s_nationkey") * 5.0).alias("lon"))
    b = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return s.join(b, "s_suppkey").select(F.col("s_suppkey").alias("i"), "j", r(joins.haversine("lat", "lon", "lat2", "lon2")).alias("km"))


@query("SELECT a.p_partkey AS i, b.p_partkey AS j, round((a.p_size - b.p_size) ^ 2 + ((a.p_retailprice - b.p_retailprice) / 10) ^ 2, 6) AS d2 FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND (a.p_size - b.p_size) ^ 2 + ((a.p_retailprice - b.p_retailprice) / 10) ^ 2 <= 1.005")
def epsilon_join(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 10).alias("x"))
    return joins.within(p, "p_partkey", ["p_size", "x"], 1.005, r)


def _edges(spark, sf_dir):
    """Customers' nations to suppliers' nations through orders."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"), "l_quantity")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("l_quantity").alias("w"))


_E = "(SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, l_quantity AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"SELECT k AS node, round(coalesce(d, 0) / 24, 9) AS centrality FROM range(25) x(k) LEFT JOIN (SELECT src, count(*) AS d FROM {_E} GROUP BY 1) ON k = src")
def degree_centrality(spark, sf_dir):
    return graph.degree_centrality(_edges(spark, sf_dir), 25).select("node", r("centrality", 9).alias("centrality"))


@query(f"WITH RECURSIVE e AS (SELECT src, dst, count(*) AS k FROM {_E} GROUP BY 1, 2), d AS (SELECT src, sum(k) AS deg FROM e GROUP BY 1), s AS (SELECT e.src, e.dst, k / deg AS share FROM e JOIN d USING (src)), p(i, node, rank) AS (SELECT 0, k, 1 / 25 FROM range(25) x(k) UNION ALL SELECT i + 1, node, 0.15 / 25 + 0.85 * (coalesce(g, 0) + lost / 25) FROM (SELECT p.i, p.node, (SELECT sum(share * q.rank) FROM s JOIN p q ON s.src = q.node WHERE s.dst = p.node) AS g, (SELECT coalesce(sum(q.rank), 0) FROM p q WHERE q.node NOT IN (SELECT src FROM d)) AS lost FROM p WHERE i < 10)) SELECT node, round(rank, 7) AS rank FROM p WHERE i = 10")
def pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir), 25, rounds=10, tol=0.0).select("node", r("rank", 7).alias("rank"))


def _dense(keys, name: str, first: int):
    """The keys by rising order as numbers from first on, and how many there are."""
    from tessera.operators.aggregates import running_total

    keys = written(keys.filter(F.col(name).isNotNull()).distinct().withColumn("one", F.lit(1)), "keys")
    return running_total(keys, name, "one", "k").select(name, (F.col("k") - 1 + first).cast("long").alias(f"{name}_id")), keys.count()


def _supply(spark, sf_dir):
    """Customers to suppliers through orders, all lines, and the number of nodes: customers come first, then suppliers."""
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).filter("o_custkey IS NOT NULL AND l_suppkey IS NOT NULL")
    e = written(e.groupBy("o_custkey", "l_suppkey").agg(F.min("l_quantity").alias("w")), "lines")
    customers, n = _dense(e.select("o_custkey"), "o_custkey", 0)
    suppliers, m = _dense(e.select("l_suppkey"), "l_suppkey", n)
    e = e.join(customers, "o_custkey").join(suppliers, "l_suppkey")
    return e.select(F.col("o_custkey_id").alias("src"), F.col("l_suppkey_id").alias("dst"), "w"), n + m


_SUPPLY = """e0 AS MATERIALIZED (SELECT o_custkey AS c, l_suppkey AS s, min(l_quantity) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY 1, 2),
cs AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) - 1 AS ci FROM (SELECT DISTINCT c FROM e0)), ss AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s) - 1 + (SELECT count(*) FROM cs) AS si FROM (SELECT DISTINCT s FROM e0)),
e1 AS MATERIALIZED (SELECT ci AS a, si AS b, w FROM e0 JOIN cs USING (c) JOIN ss USING (s)), e AS MATERIALIZED (SELECT a, b, w FROM e1 UNION ALL SELECT b, a, w FROM e1)"""


@query(f"""WITH RECURSIVE {_SUPPLY}, p(k, node, l) AS (SELECT 0, a, a FROM (SELECT DISTINCT a FROM e) UNION ALL SELECT p.k + 1, p.node, least(any_value(p.l), min(q.l)) FROM p JOIN e ON e.a = p.node JOIN p q ON q.node = e.b WHERE p.k < 24 GROUP BY p.k, p.node),
f AS (SELECT node, l FROM p WHERE k = 24) SELECT node, dense_rank() OVER (ORDER BY l) - 1 AS component FROM f""")
def connected_components(spark, sf_dir):
    return graph.components(*_supply(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SUPPLY}, p(k, node, d) AS (SELECT 0, 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT k + 1, b, min(d + w) FROM p JOIN e ON a = node WHERE k < 40 GROUP BY k, b) SELECT node, round(min(d), 4) AS d FROM p GROUP BY node""")
def shortest_paths(spark, sf_dir):
    edges, n = _supply(spark, sf_dir)
    return graph.shortest_paths(edges, 0, n, directed=False).select("node", r("d", 4).alias("d"))


@query(f"""WITH RECURSIVE {_SUPPLY}, p(hops, node) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT hops + 1, b FROM p JOIN e ON a = node WHERE hops < 40) SELECT node, min(hops) AS hops FROM p GROUP BY node""")
def breadth_first(spark, sf_dir):
    edges, n = _supply(spark, sf_dir)
    return graph.bfs(edges, 0, n)


@query("SELECT event_type, round(avg(CASE WHEN rn > 1 THEN (s <> ps)::INT END), 6) AS rate FROM (SELECT event_type, value >= 0 AS s, lag(value >= 0) OVER w AS ps, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) GROUP BY 1")
def zero_crossing_rate(spark, sf_dir):
    from tessera.operators.windows import ordered

    w = ordered("event_type", ["ts", "event_id"])
    s = (F.col("value") >= 0).cast("int")
    return t(spark, sf_dir, "events").withColumn("c", F.abs(s - F.lag(s).over(w))).groupBy("event_type").agg(r(F.avg("c")).alias("rate"))


@query("""WITH x AS (SELECT datediff('day', o_orderdate, l_shipdate) AS t, (l_returnflag = 'R')::INT AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT t, sum(e) AS d, count(*) AS c FROM x GROUP BY 1), r AS (SELECT t, d, sum(c) OVER (ORDER BY t DESC) AS n FROM g)
SELECT t, d::BIGINT AS events, n::BIGINT AS at_risk, round(exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE -1000 END) OVER (ORDER BY t)), 6) AS survival FROM r""")
def kaplan_meier(spark, sf_dir):
    """Times are days: their counts, not the rows, are what is ordered."""
    from pyspark.sql.window import Window

    x = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = x.groupBy(F.datediff("l_shipdate", "o_orderdate").alias("t")).agg(F.count_if(F.col("l_returnflag") == "R").alias("events"), F.count("*").alias("c"))
    down, up = Window.orderBy(F.desc("t")), Window.orderBy("t")
    g = g.withColumn("at_risk", F.sum("c").over(down))
    s = F.when(F.col("events") < F.col("at_risk"), F.ln(F.when(F.col("events") < F.col("at_risk"), 1 - F.col("events") / F.col("at_risk")))).otherwise(-1000.0)
    return g.select(F.col("t").cast("long").alias("t"), "events", "at_risk", r(F.exp(F.sum(s).over(up))).alias("survival"))


@query("SELECT doc_id, word, n, round(n / total * ln(docs / df), 8) AS tfidf FROM (SELECT doc_id, word, n, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY word) AS df, (SELECT count(*) FROM benchmark) AS docs FROM (SELECT item_id AS doc_id, word, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY ALL))")
def tfidf(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    words = b.select(F.col("item_id").alias("doc_id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    totals, df = words.groupBy("doc_id").agg(F.sum("n").alias("total")), words.groupBy("word").agg(F.count("*").alias("df"))
    x = words.join(totals, "doc_id").join(df, "word").crossJoin(F.broadcast(b.agg(F.count("*").alias("docs"))))
    return x.select("doc_id", "word", "n", r(F.col("n") / F.col("total") * F.ln(F.col("docs") / F.col("df")), 8).alias("tfidf"))


@query("""SELECT a.c_mktsegment, round(sum(sign(a.c_acctbal - b.c_acctbal) * sign(a.c_nationkey - b.c_nationkey)) / sqrt(sum((a.c_acctbal <> b.c_acctbal)::INT)::DOUBLE * sum((a.c_nationkey <> b.c_nationkey)::INT)::DOUBLE), 6) AS tau
FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey GROUP BY 1""")
def kendall_by_segment(spark, sf_dir):
    from tessera.operators import series

    c = t(spark, sf_dir, "customer")
    return series.apply(c, "c_mktsegment", ["c_custkey"], ["c_acctbal", "c_nationkey"], kernels.kendall, ["tau"]).select("c_mktsegment", r("tau").alias("tau"))


_DIST = "(SELECT l_linenumber, count(*) FILTER (l_returnflag = 'R') / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') / (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1)"


@query(f"SELECT round(sum(p * ln(p / q)), 9) AS kl, round(0.5 * sum(p * ln(2 * p / (p + q))) + 0.5 * sum(q * ln(2 * q / (p + q))), 9) AS js, round(-sum(p * ln(q)), 7) AS cross_entropy, round(sqrt(sum((sqrt(p) - sqrt(q)) ^ 2) / 2), 7) AS hellinger, round(sum(abs(p - q)) / 2, 7) AS tv, round(sum((p - q) ^ 2 / q), 9) AS chi2, round(ln(sum(p * p / q)), 9) AS renyi2, round(-ln(sum(sqrt(p * q))), 9) AS bhattacharyya FROM {_DIST}")
def divergences(spark, sf_dir):
    from tessera.operators import divergences as d

    li = t(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag") == "R"
    counts = li.groupBy("l_linenumber").agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    x = counts.crossJoin(F.broadcast(counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))).select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    return x.agg(r(d.kl("p", "q"), 9).alias("kl"), r(d.js("p", "q"), 9).alias("js"), r(d.cross_entropy("p", "q"), 7).alias("cross_entropy"), r(d.hellinger("p", "q"), 7).alias("hellinger"), r(d.total_variation("p", "q"), 7).alias("tv"), r(d.chi_squared("p", "q"), 9).alias("chi2"), r(d.renyi("p", "q", 2.0), 9).alias("renyi2"), r(d.bhattacharyya("p", "q"), 9).alias("bhattacharyya"))
