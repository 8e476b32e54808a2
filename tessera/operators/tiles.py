"""Tiles of rows with their statistics, products of long matrices over semirings, gathers, symbols and sampling ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.exprs import num


def tile_stats(df: DataFrame, tile: Column, columns: list[str]) -> DataFrame:
    """tile, column and its n, nulls, min, max, sum and sum of squares; partial sums are combined before the shuffle."""
    held = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), num(c).alias("v")) for c in columns]))
    rows = df.select(tile.alias("tile"), held.alias("h")).select("tile", "h.column", "h.v")
    stats = [F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_sq")]
    return rows.groupBy("tile", "column").agg(*stats)


def merged_stats(stats: DataFrame) -> DataFrame:
    """Statistics of whole columns from those of their tiles, without the rows; with mean and variance."""
    out = stats.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("n", "nulls")], F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"))
    mean = F.col("sum") / F.col("n")
    return out.withColumn("mean", mean).withColumn("variance", (F.col("sum_sq") - F.col("n") * mean * mean) / (F.col("n") - 1))


def skipped(df: DataFrame, tile: Column, stats: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with the column in [low, high], from the tiles alone whose range meets it."""
    met = stats.filter((F.col("column") == column) & (F.col("max") >= low) & (F.col("min") <= high)).select(F.col("tile").alias("_tile"))
    return df.withColumn("_own", tile).join(met, F.col("_own") == F.col("_tile"), "left_semi").drop("_own").filter(F.col(column).between(low, high))


#: Of each semiring: how products are added, and how two values are multiplied.
SEMIRINGS: dict[str, tuple[Callable, Callable]] = {
    "plus_times": (F.sum, lambda a, b: a * b),
    "min_plus": (F.min, lambda a, b: a + b),
    "max_plus": (F.max, lambda a, b: a + b),
    "max_min": (F.max, lambda a, b: F.least(a, b)),
    "or_and": (F.bool_or, lambda a, b: (a != 0) & (b != 0)),
}


def product(a: DataFrame, b: DataFrame, semiring: str = "plus_times") -> DataFrame:
    """i, j, v of the product of matrices given as rows i, j, v; only cells with a pair of factors are there."""
    add, times = SEMIRINGS[semiring]
    pairs = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return pairs.groupBy("i", "j").agg(add(times(F.col("x"), F.col("y"))).alias("v"))


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j and the squared distance of rows of a to rows of b, both dense and given as i, j, v; b is a table of centres."""
    pairs = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("y")), "k")
    return pairs.groupBy("i", "j").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("v"))


def gather(values: DataFrame, at: DataFrame, index: str, missing: float | None = None) -> DataFrame:
    """The rows of ``at`` with the value that stands at their index; a sentinel or null where there is none."""
    found = at.join(values.select(F.col("i").alias(index), "v"), index, "left")
    return found if missing is None else found.withColumn("v", F.coalesce("v", F.lit(missing)))


def scattered(values: DataFrame, rows: DataFrame, index: str, value: str) -> DataFrame:
    """values (i, v) with those of the rows added at their index."""
    sums = rows.groupBy(F.col(index).alias("i")).agg(F.sum(value).alias("_s"))
    return values.join(sums, "i", "left").select("i", (F.col("v") + F.coalesce("_s", F.lit(0.0))).alias("v"))


def symbolised(df: DataFrame, key: str, order: list[str], column: str, n: int, out: str = "symbol") -> DataFrame:
    """Each row's n-tile by the column within its key, from 0."""
    return df.withColumn(out, F.ntile(n).over(Window.partitionBy(key).orderBy(column, *order)) - 1)


def top_logits(df: DataFrame, key: str, token: str, logit: str, k: int | None = None, p: float | None = None) -> DataFrame:
    """The k largest logits of a key, or the fewest whose shares sum to p, with the shares among those kept."""
    order = Window.partitionBy(key).orderBy(F.desc(logit), token)
    every = Window.partitionBy(key)
    e = F.exp(F.col(logit) - F.max(logit).over(every))
    ranked = df.withColumn("_e", e).withColumn("_r", F.row_number().over(order))
    if k is not None:
        ranked = ranked.filter(F.col("_r") <= k)
    if p is not None:
        share = F.col("_e") / F.sum("_e").over(every)
        before = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, -1))
        ranked = ranked.withColumn("_b", F.coalesce(before, F.lit(0.0))).filter(F.col("_b") < p)
    return ranked.select(key, token, logit, (F.col("_e") / F.sum("_e").over(every)).alias("share"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """The column's distinct values with codes from 0 in their order."""
    from tessera.operators.aggregates import running_total
    from tessera.operators.stages import written

    values = written(df.select(column).dropna().distinct().withColumn("one", F.lit(1)), "values")
    return running_total(values, column, "one", "k").select(column, (F.col("k") - 1).cast("long").alias("code"))


def vector_distance(kind: str, a: Column, b: Column) -> Column:
    """Of two arrays of doubles: euclidean, manhattan, chebyshev, cosine, angular, poincare (both within the unit ball)."""
    fold = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    cosine = fold(lambda x, y: x * y) / F.sqrt(square(a) * square(b))
    d2 = fold(lambda x, y: (x - y) * (x - y))
    return {
        "euclidean": lambda: F.sqrt(d2), "manhattan": lambda: fold(lambda x, y: F.abs(x - y)), "chebyshev": lambda: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
        "cosine": lambda: 1.0 - cosine, "angular": lambda: F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))),
        "poincare": lambda: F.acosh(1.0 + 2.0 * d2 / ((1.0 - square(a)) * (1.0 - square(b)))),
    }[kind]()
