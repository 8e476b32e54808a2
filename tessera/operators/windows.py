"""Windows and scans: cumulative and rolling statistics, lags, local context, linear recurrences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.exprs import INF, NAN, div, ln, num


def ordered(key: str | list[str], order: str | list[str]) -> WindowSpec:
    key, order = ([x] if isinstance(x, str) else x for x in (key, order))
    return Window.partitionBy(*key).orderBy(*order)


def scan(op: str, c, w: WindowSpec, ref: float = 0.0) -> Column:
    """An inclusive scan: add, mul, max, min, count, mean (Welford), variance (of the sample, 0 up to one row), sum_sq, sum_cube, centred."""
    x, run = num(c), w.rowsBetween(Window.unboundedPreceding, 0)
    made = {
        "add": lambda: F.sum(x), "mul": lambda: F.product(x), "max": lambda: F.max(x), "min": lambda: F.min(x), "count": lambda: F.count(x),
        "mean": lambda: F.avg(x), "sum_sq": lambda: F.sum(x * x), "sum_cube": lambda: F.sum(x * x * x), "centred": lambda: F.sum(x - ref),
    }
    if op == "variance":
        return F.coalesce(F.var_samp(x).over(run), F.lit(0.0))
    return made[op]().over(run)


def rolling(c, w: WindowSpec, size: int) -> dict[str, Column]:
    """mean, std (of the population) and zscore over trailing windows, partial at the start. All share one sort."""
    x, frame = num(c), w.rowsBetween(-(size - 1), 0)
    m, s = F.avg(x).over(frame), F.stddev_pop(x).over(frame)
    return {"mean": m, "std": s, "zscore": F.when(s > 1e-12, (x - m) / F.nullif(s, F.lit(0.0))).otherwise(0.0)}


def rolling_variance_full(df: DataFrame, c: str, key: str, order: list[str], size: int, out: str = "variance") -> DataFrame:
    """Population variance of full windows only."""
    w = ordered(key, order)
    return df.withColumn(out, F.var_pop(num(c)).over(w.rowsBetween(-(size - 1), 0))).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") >= size).drop("_r")


def moving_average(c, w: WindowSpec, size: int) -> Column:
    """Centred, cut at the edges."""
    return F.avg(num(c)).over(w.rowsBetween(-(size // 2), size - size // 2 - 1))


def median_filter(c, w: WindowSpec, size: int) -> Column:
    return F.percentile(num(c), 0.5).over(w.rowsBetween(-(size // 2), size - size // 2 - 1))


def lag_transform(kind: str, c, w: WindowSpec, k: int = 1) -> Column:
    x = num(c)
    y = F.lag(x, k).over(w)
    return {
        "value": lambda: x - y, "log": lambda: F.when((x > 0) & (y > 0), ln(x) - ln(y)),
        "percent": lambda: F.when(y != 0, F.try_divide(x - y, y)), "direction": lambda: F.signum(x - y),
    }[kind]()


def log_return(price, w: WindowSpec) -> Column:
    p = num(price)
    q = F.lag(p).over(w)
    return F.when((p > 0) & (q > 0), F.ln(F.try_divide(p, q)))


def simple_return(price, w: WindowSpec) -> Column:
    p = num(price)
    q = F.lag(p).over(w)
    return F.when(q != 0, F.try_divide(p, q) - 1)


def local_context(c, w: WindowSpec, offsets: list[int]) -> dict[str, Column]:
    """Neighbourhood features; neighbours out of range take the centre's value."""
    x = num(c)
    near = {k: F.coalesce(F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w) if k < 0 else x, x) for k in offsets}
    values, n = list(near.values()), len(offsets)
    mean = sum(values[1:], values[0]) / n
    mid = sum(offsets) / n
    sxx = sum((k - mid) ** 2 for k in offsets)
    slope = sum((v * ((k - mid) / sxx) for k, v in near.items()), F.lit(0.0)) if sxx else F.lit(0.0)
    others = [v for k, v in near.items()]
    peak = F.when(x > F.greatest(*others, F.lit(-INF)), 1).when(x < F.least(*others, F.lit(INF)), -1).otherwise(0)
    out = {"mean": mean, "std": F.sqrt(sum(((v - mean) * (v - mean) for v in values), F.lit(0.0)) / n), "slope": slope, "peak": peak}
    for k, v in near.items():
        out |= {f"raw_{k}": v, f"delta_{k}": x - v, f"log_ratio_{k}": F.when((v > 0) & (x > 0), F.ln(F.when(v > 0, F.try_divide(x, v)))).otherwise(0.0), f"direction_{k}": F.signum(x - v)}
    return out


def max_drawdown(df: DataFrame, price: str, key: str, order: list[str]) -> DataFrame:
    """Largest relative fall from a running maximum by group; NULL if any price is not positive."""
    top = F.max(num(price)).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_d", F.when(top > 0, F.try_divide(top - num(price), top)))
    return rows.groupBy(key).agg(F.when(F.min(num(price)) > 0, F.max("_d")).alias("max_drawdown"))


def series(df: DataFrame, c: str, key: str, order: list[str], out: str = "series") -> DataFrame:
    """One ordered array a group. A group must fit into a row; folds over larger ones belong to windows."""
    at = F.struct(*order, num(c).alias("_x"))
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["_x"]).alias(out))


def ema(xs: Column, alpha: float) -> Column:
    """The last level of s = (1 - alpha) s + alpha x, from the first value."""
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.element_at(xs, 1), lambda s, x: (1 - alpha) * s + alpha * x)


def ewm(xs: Column, alpha: float) -> Column:
    """alpha times the weighted mean of weights (1 - alpha)**age, as the associative scan gives it."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"))
    return F.aggregate(xs, start, lambda s, x: F.struct((s["w"] * (1 - alpha) + 1.0).alias("w"), (s["v"] * (1 - alpha) + alpha * x).alias("v")), lambda s: F.try_divide(s["v"], s["w"]))


def holt(xs: Column, alpha: float, beta: float, horizon: int) -> Column:
    """The forecast at the horizon; level from the first value, trend from the first step."""
    first, second = F.element_at(xs, 1), F.try_element_at(xs, F.lit(2))
    start = F.struct(first.alias("l"), (second - first).alias("t"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["l"] + s["t"])
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * s["t"]).alias("t"))

    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), start, step, lambda s: s["l"] + horizon * s["t"])


def ewma_variance(rs: Column, decay: float = 0.94) -> Column:
    """The last of v = decay v + (1 - decay) r**2 of the return before, from max(r0**2, 1e-15)."""
    r0 = F.element_at(rs, 1)
    return F.aggregate(F.slice(rs, 1, F.greatest(F.size(rs) - 1, F.lit(0))), F.greatest(r0 * r0, F.lit(1e-15)), lambda v, r: decay * v + (1 - decay) * r * r)


def affine_scan(xs: Column, a: float, b: float, start: float = 0.0) -> Column:
    """The last state of s = a s + b x."""
    return F.aggregate(xs, F.lit(start), lambda s, x: a * s + b * x)


def kalman_gain(f: float = 0.98, h: float = 1.0, q: float = 0.01, r: float = 0.1) -> tuple[float, float]:
    """The steady state's (a, k): state = a state + k x, from the scalar Riccati equation."""
    # p = f^2 p r / (h^2 p + r) + q, a quadratic in p
    b = r - f * f * r - q * h * h
    p = (-b + math.sqrt(b * b + 4 * h * h * q * r)) / (2 * h * h)
    k = p * h / (h * h * p + r)
    return f * (1 - k * h), k


def kalman_filter(xs: Column, f: float = 0.98, h: float = 1.0, q: float = 0.01, r: float = 0.1) -> Column:
    a, k = kalman_gain(f, h, q, r)
    return affine_scan(xs, a, k)


def kalman_scalar(xs: Column, f: float, h: float, q: float, r: float, x0: float = 0.0, p0: float = 1.0) -> Column:
    """State and variance after the series, by the exact recursion."""
    start = F.struct(F.lit(x0).alias("x"), F.lit(p0).alias("p"))

    def step(s: Column, z: Column) -> Column:
        x, p = f * s["x"], f * f * s["p"] + q
        k = p * h / (h * h * p + r)
        return F.struct((x + k * (z - h * x)).alias("x"), ((1 - k * h) * p).alias("p"))

    return F.aggregate(xs, start, step)


def seconds_of_day(ns: Column) -> Column:
    return F.pmod(ns, F.lit(86_400_000_000_000)).cast("double") / 1e9


def time_of_day(ns: Column) -> tuple[Column, Column]:
    angle = seconds_of_day(ns) / 86400.0 * (2 * math.pi)
    return F.sin(angle), F.cos(angle)


def transform(kind: str, c) -> Column:
    x = num(c)
    return {
        "log": lambda: F.when(x > 0, F.ln(F.when(x > 0, x))).otherwise(F.lit(NAN)), "sqrt": lambda: F.when(x >= 0, F.sqrt(x)).otherwise(F.lit(NAN)),
        "reciprocal": lambda: F.when(F.abs(x) > 1e-300, div(1.0, x)).otherwise(F.lit(NAN)),
    }[kind]()


class Pipeline:
    """Rolling transforms collected into one projection, so equal windows share one sort and equal requests one column."""

    def __init__(self, df: DataFrame, key: str, order: list[str]):
        self.df, self.w, self.columns = df, ordered(key, order), {}

    def _add(self, kind: str, c: str, size: int, made) -> Pipeline:
        self.columns.setdefault(f"{c}_{kind}_{size}", made)
        return self

    def rolling_mean(self, c: str, window: int = 20) -> Pipeline:
        return self._add("mean", c, window, rolling(c, self.w, window)["mean"])

    def rolling_std(self, c: str, window: int = 20) -> Pipeline:
        return self._add("std", c, window, rolling(c, self.w, window)["std"])

    def rolling_zscore(self, c: str, window: int = 20) -> Pipeline:
        return self._add("zscore", c, window, rolling(c, self.w, window)["zscore"])

    def execute(self) -> DataFrame:
        return self.df.select("*", *[c.alias(n) for n, c in self.columns.items()])
