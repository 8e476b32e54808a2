"""Mergeable sketches: distinct counts, quantiles, frequencies, membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.exprs import num


def hll(c, precision: int = 12) -> Column:
    return F.hll_sketch_agg(F.col(c).cast("string"), precision)


def hll_estimate(sketch) -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_merge(sketch) -> Column:
    return F.hll_union_agg(sketch)


def gk_quantile(c, q: float, accuracy: int = 1000) -> Column:
    return F.percentile_approx(num(c), q, accuracy)


def kll(c, k: int = 200) -> Column:
    return F.kll_sketch_agg_double(num(c), F.lit(k))


def kll_quantile(sketch, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def dd_buckets(df: DataFrame, keys: list[str], c: str, accuracy: float = 0.01) -> DataFrame:
    """Counts of log-width buckets, which merge by adding: sign and index of each value's bucket."""
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    x = num(c)
    index = F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.when(x != 0, F.abs(x))) / gamma))
    rows = df.filter(x.isNotNull() & ~F.isnan(x))
    return rows.groupBy(*keys, F.signum(x).cast("int").alias("sign"), index.alias("bucket")).agg(F.count("*").alias("n"))


def dd_quantile(buckets: DataFrame, keys: list[str], q: float, accuracy: float = 0.01) -> DataFrame:
    """A value within the relative accuracy of the quantile. Few rows a group, as buckets grow with the range's logarithm."""
    gamma = (1 + accuracy) / (1 - accuracy)
    order = Window.partitionBy(*keys).orderBy(F.col("sign") * F.when(F.col("sign") == 0, 0).otherwise(F.col("bucket") + 100_000))
    total = F.sum("n").over(Window.partitionBy(*keys))
    value = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    seen = buckets.withColumn("_c", F.sum("n").over(order)).withColumn("_t", total).withColumn("_v", value)
    return seen.filter(F.col("_c") > q * (F.col("_t") - 1)).groupBy(*keys).agg(F.min_by("_v", "_c").alias("quantile"))


def count_min(df: DataFrame, c: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """Cells (row, cell, n) of a count-min sketch; two sketches merge by adding."""
    cells = [F.struct(F.lit(d).alias("row"), F.pmod(F.xxhash64(F.col(c), F.lit(d)), F.lit(width)).alias("cell")) for d in range(depth)]
    return df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.row", "x.cell").agg(F.count("*").alias("n"))


def count_min_estimate(sketch: DataFrame, items: DataFrame, c: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """An estimate, never too low, of how often each item occurs."""
    cells = [F.struct(F.lit(d).alias("row"), F.pmod(F.xxhash64(F.col(c), F.lit(d)), F.lit(width)).alias("cell")) for d in range(depth)]
    asked = items.select(c, F.explode(F.array(*cells)).alias("x")).select(c, "x.row", "x.cell")
    return asked.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(c).agg(F.coalesce(F.min("n"), F.lit(0)).alias("estimate"))


def bloom(df: DataFrame, c: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Words (word, bits) of a Bloom filter; two filters unite by bit_or."""
    at = [F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(bits)) for k in range(hashes)]
    rows = df.select(F.explode(F.array(*at)).alias("b"))
    return rows.groupBy(F.floor(F.col("b") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(b, 32) AS INT))")).alias("bits"))


def bloom_contains(words: DataFrame, items: DataFrame, c: str, bits: int = 1 << 16, hashes: int = 4) -> DataFrame:
    """Items with ``maybe``; a filter has a fixed size, so it is broadcast."""
    at = [F.pmod(F.xxhash64(F.col(c), F.lit(k)), F.lit(bits)) for k in range(hashes)]
    asked = items.select(c, F.explode(F.array(*at)).alias("b")).withColumn("word", F.floor(F.col("b") / 32).cast("int"))
    hit = F.coalesce(F.expr("shiftright(bits, CAST(pmod(b, 32) AS INT)) & 1L"), F.lit(0))
    return asked.join(F.broadcast(words), "word", "left").groupBy(c).agg((F.min(hit) == 1).alias("maybe"))


def top_k(df: DataFrame, c: str, k: int) -> DataFrame:
    """Exact heavy hitters; ties by value."""
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)
