"""Kernels over ordered series, one a group, through Arrow-based grouped functions.

A series is one task's: its order and values, and nothing else of its rows. What decomposes (moments, lagged sums, realized
measures, counts of patterns) is written with windows and aggregates instead, which split groups of any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.exprs import num


def apply(df: DataFrame, key: str, order: list[str], columns: list[str], kernel: Callable, outputs: list[str]) -> DataFrame:
    """key and the kernel's outputs (double) of each group. The kernel gets one array a column, in order, NULLs and NaN rows left out."""
    kind = dict(df.dtypes)[key]
    ddl = f"{key} {kind}, " + ", ".join(f"{o} double" for o in outputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable")[[f"_{i}" for i in range(len(columns))]].dropna()
        value = kernel(*[rows[c].to_numpy(float) for c in rows.columns]) if len(rows) else float("nan")
        found = value if isinstance(value, dict) else dict(zip(outputs, np.atleast_1d(value), strict=False))
        return pd.DataFrame([{key: pdf[key].iloc[0]} | {o: float(found.get(o, np.nan)) for o in outputs}])

    rows = df.select(key, *order, *[num(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return rows.groupBy(key).applyInPandas(run, ddl)


def vectors(df: DataFrame, key: str, order: list[str], column: str, kernel: Callable) -> DataFrame:
    """key, i and value of a kernel that gives an array."""
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")["_x"].dropna().to_numpy(float)
        out = np.asarray(kernel(x), float) if len(x) else np.empty(0)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "i": range(len(out)), "value": out})

    return df.select(key, *order, num(column).alias("_x")).groupBy(key).applyInPandas(run, f"{key} {kind}, i long, value double")


def summary(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The complexity measures of each group in one pass over it."""
    names = ["sample_entropy", "permutation_entropy", "hurst", "dfa", "higuchi", "lempel_ziv"]

    def measure(x: np.ndarray) -> dict:
        if len(x) < 3:
            return {}
        return {
            "sample_entropy": kernels.sample_entropy(x), "permutation_entropy": kernels.permutation_entropy(x), "hurst": kernels.hurst_rs(x),
            "dfa": kernels.dfa(x), "higuchi": kernels.higuchi(x), "lempel_ziv": kernels.lempel_ziv(x),
        }

    return apply(df, key, order, [column], measure, names)


def realized(df: DataFrame, key: str, order: list[str], price: str) -> DataFrame:
    """Realized variance, bipower variation and jump ratio of log returns; windows and aggregates only."""
    import math

    from tessera.operators.windows import log_return, ordered

    w = ordered(key, order)
    r = df.withColumn("_r", log_return(price, w))
    r = r.withColumn("_q", F.lag("_r").over(w))
    rv, bv = F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)), F.coalesce(math.pi / 2 * F.sum(F.abs("_r") * F.abs("_q")), F.lit(0.0))
    out = r.groupBy(key).agg(rv.alias("realized_variance"), bv.alias("bipower_variation"), F.count("_r").alias("n"))
    jump = F.when(F.col("realized_variance") > 1e-15, F.greatest(F.col("realized_variance") - F.col("bipower_variation"), F.lit(0.0)) / F.col("realized_variance"))
    return out.withColumn("realized_volatility", F.sqrt("realized_variance")).withColumn("jump_ratio", jump)


def acf(df: DataFrame, key: str, order: list[str], column: str, max_lag: int) -> DataFrame:
    """key, lag and autocorrelation, by windows: one sort, one aggregate."""
    from tessera.operators.windows import ordered

    w = ordered(key, order)
    mean = df.groupBy(key).agg(F.avg(num(column)).alias("_m"))
    d = df.join(mean, key).withColumn("_d", num(column) - F.col("_m"))
    lags = d.select(key, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    sums = lags.groupBy(key).agg(F.sum(F.col("_d") * F.col("_d")).alias("s0"), F.count("_d").alias("n"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    flat = F.col("s0") / F.col("n") < 1e-15
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("n") > k, F.when(flat, 1.0).otherwise(F.try_divide(f"s{k}", "s0"))).alias("acf")) for k in range(max_lag + 1)])
    return sums.select(key, F.explode(rows).alias("r")).select(key, "r.lag", "r.acf").filter("acf IS NOT NULL")
