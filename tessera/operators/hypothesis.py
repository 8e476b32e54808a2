"""Hypothesis tests: statistics as aggregate expressions, p-values on the driver from one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import special as sp
from tessera.functions.exprs import num
from tessera.operators.aggregates import average_ranks, moments


def one_sample_t(c: str, mu: float = 0.0) -> Column:
    x = num(c)
    return (F.avg(x) - mu) / (F.stddev_samp(x) / F.sqrt(F.count(x)))


def welch_t(c: str, group: Column) -> Column:
    """Of the rows under the condition against the others."""
    x, y = F.when(group, num(c)), F.when(~group, num(c))
    return (F.avg(x) - F.avg(y)) / F.sqrt(F.var_samp(x) / F.count(x) + F.var_samp(y) / F.count(y))


def welch_df(c: str, group: Column) -> Column:
    a, b = (F.var_samp(F.when(g, num(c))) / F.count(F.when(g, num(c))) for g in (group, ~group))
    n, m = (F.count(F.when(g, num(c))) for g in (group, ~group))
    return (a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1))


def pooled_t(c: str, group: Column) -> Column:
    x, y = F.when(group, num(c)), F.when(~group, num(c))
    n, m = F.count(x), F.count(y)
    pooled = ((n - 1) * F.var_samp(x) + (m - 1) * F.var_samp(y)) / (n + m - 2)
    return (F.avg(x) - F.avg(y)) / F.sqrt(pooled * (1.0 / n + 1.0 / m))


def cohens_d(c: str, group: Column) -> Column:
    x, y = F.when(group, num(c)), F.when(~group, num(c))
    n, m = F.count(x), F.count(y)
    return (F.avg(x) - F.avg(y)) / F.sqrt(((n - 1) * F.var_samp(x) + (m - 1) * F.var_samp(y)) / (n + m - 2))


def paired_t(a: str, b: str) -> Column:
    d = num(a) - num(b)
    return F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))


def anova(df: DataFrame, c: str, group: str) -> DataFrame:
    """One row: f, df_between, df_within, eta2."""
    x = num(c)
    g = df.filter(x.isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    k, n = F.count("*"), F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    within = F.sum((F.col("n") - 1) * F.col("v"))
    return g.agg(((between / (k - 1)) / (within / (n - k))).alias("f"), (k - 1).alias("df_between"), (n - k).alias("df_within"), (between / (between + within)).alias("eta2"))


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof and cramers_v of a contingency table. Empty cells are counted without being made."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    full = cells.join(rows, a).join(cols, b)
    share = F.col("o") * F.col("o") / (F.col("r") * F.col("c").cast("double"))
    s = full.agg(F.sum(share).alias("share"), F.count_distinct(a).alias("i"), F.count_distinct(b).alias("j"), F.sum("o").alias("n"))
    s = s.select((F.col("n") * (F.col("share") - 1.0)).alias("chi2"), "i", "j", "n")
    return s.select("chi2", ((F.col("i") - 1) * (F.col("j") - 1)).alias("dof"), F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("i") - 1, F.col("j") - 1))).alias("cramers_v"))


def goodness_of_fit(observed: str, expected: str) -> Column:
    o, e = num(observed), num(expected)
    return F.sum(F.when(e > 0, (o - e) * (o - e) / e))


def mann_whitney(df: DataFrame, c: str, group: Column) -> DataFrame:
    """One row: u (the smaller) and z, tie-corrected. Values are counted first, so ranking never moves all rows to one task."""
    x = df.select(num(c).alias("x"), group.alias("g")).filter("x IS NOT NULL AND g IS NOT NULL")
    counts = x.groupBy("x").agg(F.count_if("g").alias("a"), F.count("*").alias("t"))
    ranks = _tied_ranks(counts)
    s = ranks.agg(F.sum("a").alias("n"), F.sum(F.col("t") - F.col("a")).alias("m"), F.sum(F.col("a") * F.col("r")).alias("rank_sum"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n, m, total = F.col("n"), F.col("m"), F.col("n") + F.col("m")
    u = F.col("rank_sum") - n * (n + 1) / 2
    var = n * m / 12.0 * (total + 1 - F.col("ties") / (total * (total - 1)))
    return s.select(F.least(u, n * m - u).alias("u"), ((F.least(u, n * m - u) - n * m / 2) / F.sqrt(var)).alias("z"))


def _tied_ranks(counts: DataFrame) -> DataFrame:
    """counts: x, t (rows of the value), others. Adds r, the value's average rank."""
    from tessera.operators.aggregates import running_total

    return running_total(counts, "x", "t", "_c").withColumn("r", F.col("_c") - (F.col("t") - 1) / 2.0)


def kruskal(df: DataFrame, c: str, group: str) -> DataFrame:
    """One row: h, tie-corrected, and its degrees of freedom."""
    x = df.select(num(c).alias("x"), F.col(group).alias("g")).filter("x IS NOT NULL")
    ranks = _tied_ranks(x.groupBy("x").agg(F.count("*").alias("t")))
    ties = ranks.agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    g = x.groupBy("x", "g").agg(F.count("*").alias("k")).join(ranks, "x").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("r")).alias("s"))
    t = g.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("k")).join(F.broadcast(ties))
    n = F.col("n")
    return t.select(((12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, F.lit(3)) - n))).alias("h"), (F.col("k") - 1).alias("dof"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    x = df.select(num(a).alias("a"), num(b).alias("b")).dropna()
    return average_ranks(average_ranks(x, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman"))


def adjust(df: DataFrame, p: str, how: str, key: list[str] | None = None) -> DataFrame:
    """Adds ``adjusted``: bonferroni, holm or bh, over all rows or within keys. P-values of one family are few."""
    from pyspark.sql.window import Window

    keys = key or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    up = w.orderBy(p)
    m, r = F.count(p).over(w), F.row_number().over(up)
    x = df.withColumn("_m", m).withColumn("_r", r)
    if how == "bonferroni":
        adjusted = F.least(F.col(p) * F.col("_m"), F.lit(1.0))
    elif how == "holm":
        adjusted = F.least(F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    else:
        adjusted = F.least(F.min(F.col(p) * F.col("_m") / F.col("_r")).over(up.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))
    return x.withColumn("adjusted", adjusted).drop("_m", "_r")


def t_test(df: DataFrame, c: str, mu: float = 0.0) -> dict:
    m = moments(c)
    row = df.agg(m["n"].alias("n"), m["mean"].alias("mean"), m["std"].alias("std")).first()
    if row.n < 2 or not row.std:
        return {"statistic": math.nan, "df": row.n - 1, "p": math.nan, "effect": math.nan}
    t = (row["mean"] - mu) / (row["std"] / math.sqrt(row.n))
    half = sp.t_ppf(0.975, row.n - 1) * row["std"] / math.sqrt(row.n)
    return {"statistic": t, "df": row.n - 1, "p": sp.t_two_sided(t, row.n - 1), "effect": (row["mean"] - mu) / row["std"], "low": row["mean"] - half, "high": row["mean"] + half}
