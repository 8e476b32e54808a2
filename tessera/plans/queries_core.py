"""Queries of frames, expressions, joins, aggregates and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.frame import Expr, Frame, where
from tessera.functions import exprs
from tessera.operators import aggregates as agg
from tessera.operators import sketches, windows
from tessera.plans._queries import ORDER, PRICES, Registry, W, prices, r, t

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT p_brand, round(sum(rev), 2) AS rev_sum, round(avg(rev), 4) AS rev_mean, count(*) AS count FROM (SELECT p_brand, l_quantity * l_extendedprice * (1 - l_discount) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand")
def revenue_by_brand(spark, sf_dir):
    sales = Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_partkey", "l_quantity", "l_extendedprice", "l_discount"])
    part = Frame(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"))
    j = sales.join(part, "l_partkey")
    j = j.with_column("rev", j["l_quantity"] * j["l_extendedprice"] * (1 - j["l_discount"]))
    return j.groupby("p_brand").agg("rev").df.select("p_brand", r("rev_sum", 2).alias("rev_sum"), r("rev_mean", 4).alias("rev_mean"), "count")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def select_columns(spark, sf_dir):
    return Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def with_expression(spark, sf_dir):
    f = Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return f.with_column("charge", f["l_extendedprice"] * (1 - f["l_discount"]) * (1 + f["l_tax"])).df.select("l_orderkey", "l_linenumber", "charge")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def filter_mask(spark, sf_dir):
    f = Frame.from_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return f.filter((f["l_quantity"] > 30) & (f["l_discount"] < 0.05)).df.select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CASE WHEN NOT value > 0 OR value > 50 THEN 1.0 ELSE 0.0 END AS flag FROM events")
def boolean_algebra(spark, sf_dir):
    f = Frame(t(spark, sf_dir, "events"))
    return f.with_column("flag", ~(f["value"] > 0) | (f["value"] > 50)).df.select("event_id", "flag")


@query("SELECT event_id, round(CASE WHEN value > 0 THEN sqrt(abs(value)) ELSE -value END, 6) AS v FROM events")
def where_expression(spark, sf_dir):
    df = t(spark, sf_dir, "events")
    v = where((Expr("value") > 0).column, F.sqrt(F.abs("value")), -F.col("value"))
    return df.select("event_id", r(v).alias("v"))


@query("SELECT event_id, CASE WHEN user_id = 0 THEN NULL ELSE round(value / user_id, 6) END AS ratio, user_id = 0 AS is_odd FROM (SELECT event_id, value, user_id % 7 AS user_id FROM events)")
def safe_division(spark, sf_dir):
    df = t(spark, sf_dir, "events").withColumn("d", F.col("user_id") % 7)
    q = exprs.div("value", "d")
    odd = F.isnan(q) | (F.abs(q) == float("inf"))
    return df.select("event_id", r(F.when(~odd, q)).alias("ratio"), odd.alias("is_odd"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN exp(-abs(value) / 100) ELSE greatest(value, -1.0) END, 6) AS phi FROM events")
def phi_formula(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", r(exprs.phi("v > 0 ? exp(-fabs(v) / 100.0) : fmax(v, -1.0)", v="value")).alias("phi"))


@query("SELECT event_id, round(least(greatest(value * value, 1.0), 1000.0) + sin(value) - CASE WHEN value > 5 THEN 1.0 ELSE 2.0 END, 6) AS tree FROM events")
def expression_tree(spark, sf_dir):
    e = ("sub", ("add", ("clamp", ("sq", "value"), 1.0, 1000.0), ("sin", "value")), ("if", ("gt", "value", 5.0), 1.0, 2.0))
    return t(spark, sf_dir, "events").select("event_id", r(exprs.tree(e)).alias("tree"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 100")
def sort_head(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return df.orderBy(F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")).limit(100)


@query("SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat(spark, sf_dir):
    a = Frame(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")))
    b = Frame(t(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")))
    return a.concat(b).df


_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(_DESCRIBE)
def describe(spark, sf_dir):
    d = Frame(t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")).describe().df
    return d.select("column", "count", *[r(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY l_suppkey")
def groupby_sum(spark, sf_dir):
    return Frame(t(spark, sf_dir, "lineitem")).groupby("l_suppkey").sum("l_extendedprice").df.select("l_suppkey", r("l_extendedprice", 2).alias("l_extendedprice"))


@query("SELECT l_orderkey, round(avg(l_extendedprice), 7) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def groupby_mean_high_cardinality(spark, sf_dir):
    return Frame(t(spark, sf_dir, "lineitem")).groupby("l_orderkey").mean("l_extendedprice").df.select("l_orderkey", r("l_extendedprice", 7).alias("l_extendedprice"))


@query("SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey")
def groupby_count(spark, sf_dir):
    return Frame(t(spark, sf_dir, "lineitem")).groupby("l_suppkey").count().df


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem GROUP BY l_suppkey")
def groupby_fused_expression(spark, sf_dir):
    f = Frame(t(spark, sf_dir, "lineitem"))
    return f.groupby("l_suppkey").sum_expr(f["l_extendedprice"] * (1 - f["l_discount"]), "rev").df.select("l_suppkey", r("rev", 2).alias("rev"))


@query("SELECT round(sum(l_quantity * l_extendedprice + l_tax), 2) AS s, round(sum(l_extendedprice) FILTER (l_quantity > 25), 2) AS filtered, round(sum(sqrt(abs(l_discount - 0.05))), 6) AS root FROM lineitem")
def fused_sums(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    a, q, x, d = (Expr(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    return df.agg(r(F.sum((a * q + x).column), 2).alias("s"), r(F.sum(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice"))), 2).alias("filtered"), r(F.sum(abs(d - 0.05).sqrt().column)).alias("root"))


@query("SELECT count(*) AS n, round(sum(v), 4) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT value AS v FROM events)")
def multi_output_reduce(spark, sf_dir):
    v = F.col("value")
    return t(spark, sf_dir, "events").agg(F.count(v).alias("n"), r(F.sum(v), 4).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("std"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark, sf_dir):
    o = Frame(t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_totalprice"))
    c = Frame(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"))
    return o.join(c, "k").df.select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey AS k, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def first_match_join(spark, sf_dir):
    c = Frame(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    o = Frame(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), order="o_orderkey")
    return c.join(o, "k").df


@query("SELECT DISTINCT l_partkey AS k FROM lineitem")
def dedup(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct()


@query("SELECT l_suppkey, round(sum(v), 2) AS sum, round(sum(v * v), 0) AS sum_sq, count(*) AS count, round(avg(v), 4) AS mean, round(var_samp(v), 2) AS variance, round(stddev_samp(v), 4) AS std FROM (SELECT l_suppkey, l_extendedprice AS v FROM lineitem) GROUP BY l_suppkey")
def group_statistics(spark, sf_dir):
    g = agg.group_stats(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    return g.select("l_suppkey", r("sum", 2).alias("sum"), r("sum_sq", 0).alias("sum_sq"), "count", r("mean", 4).alias("mean"), r("variance", 2).alias("variance"), r("std", 4).alias("std"))


@query("SELECT k AS s_nationkey, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM range(30) x(k) LEFT JOIN (SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS s FROM supplier GROUP BY 1) ON k = s_nationkey")
def dense_groupby(spark, sf_dir):
    return agg.dense_groupby(t(spark, sf_dir, "supplier"), "s_nationkey", 30, {"n": F.count("*"), "s": r(F.sum("s_acctbal"), 2)}, zero=("n", "s"))


@query("SELECT user_id, count(*) FILTER (value > 100) AS n, round(sum(value) FILTER (value > 100), 4) AS s FROM events GROUP BY user_id")
def masked_groupby(spark, sf_dir):
    m = agg.masked_groupby(t(spark, sf_dir, "events"), "user_id", F.col("value") > 100, {"n": F.count("*"), "s": r(F.sum("value"), 4)})
    return m.na.fill(0, ["n"])


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS lowest, arg_min(event_id, (-value, event_id)) AS highest FROM events GROUP BY user_id")
def arg_extremes(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(agg.arg_extreme("value", "event_id", False).alias("lowest"), agg.arg_extreme("value", "event_id", True).alias("highest"))


@query("SELECT event_id, round(exp(value / 100 - top) / sum(exp(value / 100 - top)) OVER (PARTITION BY event_type), 9) AS softmax FROM (SELECT *, max(value / 100) OVER (PARTITION BY event_type) AS top FROM events)")
def softmax_by_group(spark, sf_dir):
    df = t(spark, sf_dir, "events").withColumn("x", F.col("value") / 100)
    return agg.softmax(df, "event_type", "x").select("event_id", r("softmax", 9).alias("softmax"))


@query("SELECT l_suppkey, round(sum(abs(l_quantity)), 4) AS l1, round(sqrt(sum(l_quantity * l_quantity)), 6) AS l2, max(abs(l_quantity)) AS linf, max(l_quantity) - min(l_quantity) AS range, (max(l_quantity) + min(l_quantity)) / 2 AS midrange, round(sum(l_quantity * l_discount), 6) AS dot, round(sqrt(avg((l_quantity - l_discount) ^ 2)), 6) AS rmse, round(avg(abs(l_quantity - l_discount)), 6) AS mae, round(covar_samp(l_quantity, l_discount), 6) AS covariance, round(corr(l_quantity, l_discount), 6) AS pearson_r FROM lineitem GROUP BY 1")
def recipes(spark, sf_dir):
    n = agg.norms("l_quantity", "l_discount")
    keep = ("l1", "l2", "linf", "range", "midrange", "dot", "rmse", "mae", "covariance", "pearson_r")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[r(n[k]).alias(k) for k in keep])


@query("SELECT l_suppkey, round(exp(avg(ln(l_quantity))), 6) AS geometric, round(count(*) / sum(1 / l_quantity), 6) AS harmonic, round(sqrt(avg(l_quantity * l_quantity)), 6) AS quadratic FROM lineitem GROUP BY 1")
def power_means(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[r(c).alias(n) for n, c in agg.means("l_quantity").items()])


_BIN = f"SELECT user_id, floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, price, size, ts, event_id FROM {PRICES}"


@query(f"SELECT user_id, start, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(size) AS volume, round(sum(price * size) / sum(size), 6) AS vwap FROM ({_BIN}) GROUP BY ALL")
def ohlcv_hourly(spark, sf_dir):
    df = prices(spark, sf_dir).withColumn("start", agg.bucket("ts", 3600))
    return agg.ohlcv(df, ["user_id", "start"], "price", F.col("size"), ORDER).withColumn("vwap", r("vwap"))


@query(f"SELECT user_id, start, count(*) AS count, round(sum(price), 4) AS sum, round(sum(price * price), 2) AS sum_sq, round(avg(price), 6) AS mean, CASE WHEN count(*) > 1 THEN round(var_pop(price), 4) END AS variance, CASE WHEN count(*) > 1 THEN round(stddev_pop(price), 4) END AS std, min(price) AS min, max(price) AS max, first(price ORDER BY ts, event_id) AS first, last(price ORDER BY ts, event_id) AS last FROM ({_BIN}) GROUP BY ALL")
def bin_statistics(spark, sf_dir):
    b = agg.bin_stats(prices(spark, sf_dir).withColumn("start", agg.bucket("ts", 3600)), ["user_id", "start"], "price", ORDER)
    return b.withColumns({"sum": r("sum", 4), "sum_sq": r("sum_sq", 2), "mean": r("mean"), "variance": r("variance", 4), "std": r("std", 4)})


@query(" UNION ALL ".join(f"SELECT event_type, {s} AS cadence, floor(epoch(ts) / {s})::BIGINT * {s} AS start, round(sum(value), 4) AS sum, round(sum(value * value), 6) AS sum_sq, min(value) AS min, max(value) AS max, count(value)::BIGINT AS count FROM events GROUP BY ALL" for s in agg.CADENCES))
def cadence_roll_up(spark, sf_dir):
    u = agg.roll_up(t(spark, sf_dir, "events"), "event_type", "ts", "value")
    return u.select("event_type", "cadence", "start", r("sum", 4).alias("sum"), r("sum_sq", 6).alias("sum_sq"), "min", "max", "count")


@query(f"WITH s AS (SELECT user_id, start, price, price - lag(price) OVER (PARTITION BY user_id, start ORDER BY ts, event_id) AS d FROM ({_BIN})) SELECT user_id, start, count(*) AS tick_count, count(DISTINCT price) AS unique_prices, count(*) FILTER (d > 0) AS upticks, count(*) FILTER (d < 0) AS downticks, count(*) FILTER (d = 0) AS unchanged FROM s GROUP BY ALL")
def tick_counts(spark, sf_dir):
    return agg.tick_counts(prices(spark, sf_dir).withColumn("start", agg.bucket("ts", 3600)), ["user_id", "start"], "price", ORDER)


@query("SELECT event_type, true AS hll_close, true AS kll_close, true AS gk_close, true AS dd_close FROM events GROUP BY event_type")
def sketches_within_bounds(spark, sf_dir):
    """Each sketch against the exact answer of its group."""
    df = t(spark, sf_dir, "events").filter("value IS NOT NULL")
    exact = df.groupBy("event_type").agg(F.count_distinct("user_id").alias("d"), F.percentile("value", 0.5).alias("m"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("p"), sketches.hll_estimate(sketches.hll("user_id")).alias("h"), sketches.kll_quantile(sketches.kll("value"), 0.5).alias("k"), sketches.gk_quantile("value", 0.5).alias("g"))
    dd = sketches.dd_quantile(sketches.dd_buckets(df, ["event_type"], "value"), ["event_type"], 0.5).select("event_type", F.col("quantile").alias("q"))
    lo, hi = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    inside = lambda c: (F.col(c) >= lo) & (F.col(c) <= hi)
    near = (F.col("q") >= lo - F.abs(lo) * 0.02) & (F.col("q") <= hi + F.abs(hi) * 0.02)
    return exact.join(dd, "event_type").select("event_type", (F.abs(F.col("h") - F.col("d")) <= 0.1 * F.col("d") + 2).alias("hll_close"), inside("k").alias("kll_close"), inside("g").alias("gk_close"), near.alias("dd_close"))


@query("SELECT event_type, true AS never_low FROM events GROUP BY event_type")
def count_min(spark, sf_dir):
    df = t(spark, sf_dir, "events")
    exact = df.groupBy("event_type").agg(F.count("*").alias("n"))
    est = sketches.count_min_estimate(sketches.count_min(df, "event_type"), exact, "event_type")
    return exact.join(est, "event_type").select("event_type", (F.col("estimate") >= F.col("n")).alias("never_low"))


@query("SELECT DISTINCT o_custkey, true AS maybe FROM orders")
def bloom_members(spark, sf_dir):
    keys = t(spark, sf_dir, "orders").select("o_custkey").distinct()
    return sketches.bloom_contains(sketches.bloom(keys, "o_custkey", 1 << 20), keys, "o_custkey", 1 << 20)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def heavy_hitters(spark, sf_dir):
    return sketches.top_k(t(spark, sf_dir, "lineitem"), "l_partkey", 20)


@query("SELECT user_id, round(h, 6) AS entropy FROM (WITH s AS (SELECT user_id, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1), c AS (SELECT user_id, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS b, any_value(n) AS n, any_value((hi - lo) / 10) AS w, count(*) AS k FROM events JOIN s USING (user_id) WHERE hi > lo GROUP BY ALL) SELECT s.user_id, coalesce(h, 0) AS h FROM s LEFT JOIN (SELECT user_id, sum(-k / n * ln(k / n)) + ln(any_value(w)) AS h FROM c GROUP BY 1) USING (user_id))")
def histogram_entropy(spark, sf_dir):
    return agg.histogram_entropy(t(spark, sf_dir, "events"), "value", 10, "user_id").select("user_id", r("entropy").alias("entropy"))


@query(f"SELECT event_id, sum(value) OVER {W[:-1]} ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT event_id, user_id, ts, round(value)::BIGINT AS value FROM events)")
def prefix_sum(spark, sf_dir):
    df = t(spark, sf_dir, "events").withColumn("v", F.round("value").cast("long"))
    w = windows.ordered("user_id", ORDER).rowsBetween(windows.Window.unboundedPreceding, 0)
    return df.select("event_id", F.sum("v").over(w).alias("total"))


@query("SELECT o_orderkey, sum(cents) OVER (ORDER BY o_orderkey) AS total FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)")
def global_prefix_sum(spark, sf_dir):
    """A scan over the whole table's order, by ranges."""
    df: DataFrame = t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return agg.running_total(df, "o_orderkey", "cents", "total").select("o_orderkey", "total")
