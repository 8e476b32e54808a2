"""Queries of tiles, semirings, gathers, symbols, activations and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.activations import ACTIVATIONS, FORMULAS
from tessera.operators import tiles
from tessera.plans._queries import Registry, r, t

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_STATS = "count(v) AS n, count(*) - count(v) AS nulls, min(v) AS min, max(v) AS max, round(sum(v), 4) AS sum, round(sum(v * v), 2) AS sum_sq"
_LONG = "(SELECT o_orderkey // 1000 AS tile, 'o_totalprice' AS \"column\", o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey // 1000, 'o_custkey', o_custkey FROM orders)"


def _orders(spark, sf_dir):
    return t(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 1000)


@query(f'SELECT tile, "column", {_STATS} FROM {_LONG} GROUP BY 1, 2')
def tile_statistics(spark, sf_dir):
    s = tiles.tile_stats(*_orders(spark, sf_dir), ["o_totalprice", "o_custkey"])
    return s.select("tile", "column", "n", "nulls", "min", "max", r("sum", 4).alias("sum"), r("sum_sq", 2).alias("sum_sq"))


@query(f'SELECT "column", count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(var_samp(v) / 1000, 2) AS variance FROM {_LONG} GROUP BY 1')
def merged_tile_statistics(spark, sf_dir):
    s = tiles.merged_stats(tiles.tile_stats(*_orders(spark, sf_dir), ["o_totalprice", "o_custkey"]))
    return s.select("column", "n", "min", "max", r("mean").alias("mean"), r(F.col("variance") / 1000, 2).alias("variance"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
def tile_skipping(spark, sf_dir):
    o, tile = _orders(spark, sf_dir)
    return tiles.skipped(o, tile, tiles.tile_stats(o, tile, ["o_totalprice"]), "o_totalprice", 1000, 20000).select("o_orderkey", "o_totalprice")


_A = "(SELECT c_nationkey::BIGINT AS i, c_custkey % 40 AS j, round(sum(c_acctbal) / 100, 2) AS v FROM customer GROUP BY 1, 2)"
_B = "(SELECT s_suppkey % 40 AS i, s_nationkey::BIGINT AS j, round(sum(s_acctbal) / 100, 2) AS v FROM supplier GROUP BY 1, 2)"
_TIMES = {"plus_times": "round(sum(a.v * b.v), 4)", "min_plus": "round(min(a.v + b.v), 4)", "max_plus": "round(max(a.v + b.v), 4)", "max_min": "round(max(least(a.v, b.v)), 4)", "or_and": "bool_or(a.v <> 0 AND b.v <> 0)::INT"}


def _matrices(spark, sf_dir):
    total = lambda c: F.round(F.sum(c) / 100, 2).alias("v")
    a = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") % 40).alias("j")).agg(total("c_acctbal"))
    b = t(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 40).alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(total("s_acctbal"))
    return a, b


@query(" UNION ALL ".join(f"SELECT '{k}' AS semiring, a.i AS i, b.j AS j, ({v})::DOUBLE AS v FROM {_A} a JOIN {_B} b ON a.j = b.i GROUP BY a.i, b.j" for k, v in _TIMES.items()))
def semiring_products(spark, sf_dir):
    a, b = _matrices(spark, sf_dir)
    out = None
    for name in tiles.SEMIRINGS:
        p = tiles.product(a, b, name).select(F.lit(name).alias("semiring"), "i", "j", r(F.col("v").cast("int") if name == "or_and" else F.col("v"), 4).alias("v"))
        out = p if out is None else out.union(p)
    return out


@query("""WITH e AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT * FROM e WHERE i < 4)
SELECT e.i AS i, c.i AS j, round(sum((e.v - c.v) ^ 2), 5) AS v FROM e JOIN c ON e.j = c.j GROUP BY 1, 2""")
def tiled_distances(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    return tiles.distances(e, e.filter("i < 4")).select("i", "j", r("v", 5).alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey + 7 AS at, coalesce(s_acctbal, -1.0) AS v FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey + 7")
def gathered(spark, sf_dir):
    values = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    at = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + 7).alias("at"))
    return tiles.gather(values, at, "at", -1.0).select("l_orderkey", "l_linenumber", "at", "v")


@query("SELECT s_suppkey AS i, round(s_acctbal + coalesce(q, 0), 4) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def scattered_back(spark, sf_dir):
    values = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return tiles.scattered(values, t(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity").select("i", r("v", 4).alias("v"))


@query("SELECT event_id, (ntile(5) OVER (PARTITION BY user_id ORDER BY value, event_id) - 1)::INT AS symbol FROM events")
def symbols(spark, sf_dir):
    return tiles.symbolised(t(spark, sf_dir, "events"), "user_id", ["event_id"], "value", 5).select("event_id", "symbol")


_LOGITS = "(SELECT c_nationkey, c_custkey, c_acctbal / 1000 AS logit FROM customer)"


@query(f"""WITH e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY c_nationkey)) AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY logit DESC, c_custkey) AS r FROM {_LOGITS}),
b AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY c_nationkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(e) OVER (PARTITION BY c_nationkey) AS b FROM e)
SELECT 'k' AS rule, c_nationkey, c_custkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 8) AS share FROM e WHERE r <= 5
UNION ALL SELECT 'p', c_nationkey, c_custkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 8) FROM b WHERE b < 0.8""")
def top_logits(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_acctbal") / 1000).alias("logit"))
    parts = [tiles.top_logits(c, "c_nationkey", "c_custkey", "logit", **{n: v}).select(F.lit(n).alias("rule"), "c_nationkey", "c_custkey", r("share", 8).alias("share")) for n, v in (("k", 5), ("p", 0.8))]
    return parts[0].union(parts[1])


@query("SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def dictionary_codes(spark, sf_dir):
    return tiles.dictionary(t(spark, sf_dir, "part"), "p_brand")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def edit_distances(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", F.levenshtein("a", "b").alias("distance"))


_X = "(x)"
_ACT = {
    "relu": "greatest(x, 0)", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "elu": "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "sigmoid": "1 / (1 + exp(-x))", "tanh": "tanh(x)",
    "softplus": "ln(1 + exp(x))", "softsign": "x / (1 + abs(x))", "swish": "x / (1 + exp(-x))", "mish": "x * tanh(ln(1 + exp(x)))", "gelu": "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x ^ 3)))",
    "hard_sigmoid": "least(greatest(x / 6 + 0.5, 0), 1)", "step": "(x > 0)::INT::DOUBLE",
}


@query("SELECT c_custkey, " + ", ".join(f"round({e}, 8) + 0.0 AS {n}" for n, e in _ACT.items()) + " FROM (SELECT c_custkey, (c_acctbal - 4000) / 1000 AS x FROM customer)")
def activations(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") - 4000) / 1000).alias("x"))
    return c.select("c_custkey", *[r(ACTIVATIONS[n]("x"), 8).alias(n) for n in _ACT])


_PHYSICS = {
    "kinetic_energy": (("a", "b"), "0.5 * a * b * b"), "momentum": (("a", "b"), "a * b"), "pendulum_period": (("a",), "2 * pi() * sqrt(a / 9.80665)"), "spring_period": (("a", "b"), "2 * pi() * sqrt(a / b)"),
    "capacitor_energy": (("a", "b"), "0.5 * a * b * b"), "ohm_power": (("a", "b"), "a * a / b"), "ideal_gas_volume": (("a", "b", "b"), "a * 8.314462618 * b / b"), "rms_speed": (("a", "b"), "sqrt(3 * 8.314462618 * a / b)"),
    "carnot": (("a", "b"), "1 - b / a"), "doppler": (("a", "b", "s"), "a * s / (s - b)"), "thin_lens": (("a", "s"), "1 / (1 / a - 1 / s)"), "reynolds": (("a", "b", "a", "b"), "a * b * a / b"),
    "half_life_left": (("a", "b", "s"), "a * 2 ^ (-(b / s))"), "lorentz_factor": (("v",), "1 / sqrt(1 - v * v / 299792458.0 ^ 2)"),
    "wien_peak": (("a",), "2.897771955e-3 / a"), "stefan_boltzmann": (("a", "b", "a"), "a * 5.670374419e-8 * b * a ^ 4"),
}
_P = "(SELECT p_partkey, p_size + 1.0 AS a, p_retailprice / 100 AS b, 5000.0 AS s, p_size * 1e6 AS v FROM part)"


@query(f"SELECT p_partkey, {', '.join(f'round(({e})::DOUBLE, 8) + 0.0 AS {n}' for n, (_, e) in _PHYSICS.items())} FROM (SELECT p_partkey, a::DOUBLE AS a, b::DOUBLE AS b, s::DOUBLE AS s, v::DOUBLE AS v FROM {_P})")
def physics_formulas(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"), F.lit(5000.0).alias("s"), (F.col("p_size") * 1e6).alias("v"))
    return p.select("p_partkey", *[r(FORMULAS[n](*args), 8).alias(n) for n, (args, _) in _PHYSICS.items()])


_PAIR = "(SELECT a.vec_id AS i, list_transform(a.embedding, lambda z: z::DOUBLE / 100) AS a, list_transform(b.embedding, lambda z: z::DOUBLE / 100) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"""SELECT i, round(sqrt(d2), 8) AS euclidean, round(m, 8) AS manhattan, round(c, 8) AS chebyshev, round(1 - k, 8) AS cosine, round(acos(least(greatest(k, -1), 1)), 7) AS angular, round(acosh(1 + 2 * d2 / ((1 - aa) * (1 - bb))), 8) AS poincare
FROM (SELECT i, list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ^ 2)) AS d2, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS m, list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS c,
list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS k, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb FROM {_PAIR})""")
def manifold_distances(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / 100).alias("v"))
    j = e.select(F.col("vec_id").alias("i"), F.col("v").alias("a")).join(e.select((F.col("vec_id") - 1).alias("i"), F.col("v").alias("b")), "i")
    return j.select("i", *[r(tiles.vector_distance(k, F.col("a"), F.col("b")), 7 if k == "angular" else 8).alias(k) for k in ("euclidean", "manhattan", "chebyshev", "cosine", "angular", "poincare")])
