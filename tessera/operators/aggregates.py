"""Aggregates: moments, dense and masked group-bys, quantile types, robust and ordered statistics, bins, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.exprs import num


def moments(c) -> dict[str, Column]:
    """Sample variance and deviation, bias-corrected skewness and excess kurtosis, and the parts they come from."""
    x, n = num(c), F.count(c).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    return {
        "n": F.count(c), "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "variance": F.var_samp(x), "std": F.stddev_samp(x),
        "skewness": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
        "kurtosis": F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)),
        "sem": F.stddev_samp(x) / F.sqrt(n), "cv": F.stddev_samp(x) / F.nullif(F.abs(F.avg(x)), F.lit(0.0)),
    }


def means(c) -> dict[str, Column]:
    x = num(c)
    return {
        "geometric": F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.ln(x))))),
        "harmonic": F.when(F.min(x) > 0, F.count(x) / F.sum(F.when(x > 0, 1.0 / x))),
        "quadratic": F.sqrt(F.avg(x * x)),
    }


def norms(c, d=None) -> dict[str, Column]:
    """Norms of a column, and of its difference to another."""
    x = num(c)
    out = {"l1": F.sum(F.abs(x)), "l2": F.sqrt(F.sum(x * x)), "linf": F.max(F.abs(x)), "range": F.max(x) - F.min(x), "midrange": (F.max(x) + F.min(x)) / 2}
    if d is not None:
        y = num(d)
        out |= {"dot": F.sum(x * y), "ssd": F.sum((x - y) * (x - y)), "rmse": F.sqrt(F.avg((x - y) * (x - y))), "mae": F.avg(F.abs(x - y)), "covariance": F.covar_samp(x, y), "pearson_r": F.corr(x, y)}
    return out


def dense_groupby(df: DataFrame, key: str, n_groups: int, aggs: dict[str, Column], zero: tuple[str, ...] = ()) -> DataFrame:
    """Every key from 0 to n_groups - 1 once; groups without rows have 0 in the columns of ``zero``, else NULL."""
    found = df.groupBy(F.col(key).cast("long").alias(key)).agg(*[c.alias(n) for n, c in aggs.items()])
    all_keys = df.sparkSession.range(n_groups).withColumnRenamed("id", key)
    return all_keys.join(found, key, "left").na.fill(0, list(zero))


def group_stats(df: DataFrame, key: str, c: str) -> DataFrame:
    """sum, sum of squares, count, mean, variance (n - 1, never below 0) and deviation, in one pass."""
    x = num(c)
    out = df.groupBy(key).agg(F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    return out.withColumn("std", F.sqrt("variance"))


def masked_groupby(df: DataFrame, key: str, mask: Column, aggs: dict[str, Column]) -> DataFrame:
    """Groups of all rows, aggregates of those under the mask: groups without such rows stay."""
    masked = {n: c for n, c in aggs.items()}
    kept = df.filter(mask).groupBy(key).agg(*[c.alias(n) for n, c in masked.items()])
    return df.select(key).distinct().join(kept, key, "left")


def arg_extreme(value: str, index: str, largest: bool) -> Column:
    """The index of the least or greatest value, the lowest index among ties."""
    at = F.struct((F.col(value) if not largest else -F.col(value)).alias("v"), F.col(index).alias("i"))
    return F.min(F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), at))["i"]


def log_sum_exp(c: str, top: str) -> Column:
    """Of a column whose maximum a column ``top`` holds."""
    return F.ln(F.sum(F.exp(num(c) - F.col(top)))) + F.first(F.col(top))


def softmax(df: DataFrame, key: str, c: str, out: str = "softmax") -> DataFrame:
    """By group, shifted by its maximum; joined from partial aggregates, so a group may have any size."""
    top = df.groupBy(key).agg(F.max(num(c)).alias("_top"))
    shifted = df.join(top, key).withColumn("_e", F.exp(num(c) - F.col("_top")))
    total = shifted.groupBy(key).agg(F.sum("_e").alias("_total"))
    return shifted.join(total, key).withColumn(out, F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


#: Of Hyndman and Fan's quantile types: (a, b) of the plotting position h = q * (n + a) + b, counted from 1.
QUANTILE_TYPES = {4: (0.0, 0.0), 5: (0.0, 0.5), 6: (1.0, 0.0), 7: (-1.0, 1.0), 8: (1 / 3, 1 / 3), 9: (0.25, 0.375)}


def quantile_of_type(df: DataFrame, c: str, q: float, kind: int = 7, key: str | None = None) -> DataFrame:
    """One row (a key) with the quantile. Type 7 aggregates; others rank the values, as they pick order statistics."""
    keys = [key] if key else []
    if kind == 7:
        return df.groupBy(*keys).agg(F.percentile(num(c), q).alias("quantile"))
    w = Window.partitionBy(*keys)
    x = df.filter(F.col(c).isNotNull()).select(*keys, num(c).alias("x"))
    x = x.withColumn("r", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w))
    if kind == 1:
        return x.groupBy(*keys).agg(F.min(F.when(F.col("r") >= F.greatest(F.lit(1), F.ceil(q * F.col("n"))), F.col("x"))).alias("quantile"))
    a, b = QUANTILE_TYPES[kind]
    h = F.least(F.greatest(q * (F.col("n") + a) + b, F.lit(1.0)), F.col("n").cast("double"))
    lo = F.floor(h)
    value = F.sum(F.when(F.col("r") == lo, F.col("x") * (1 - (h - lo))).when(F.col("r") == lo + 1, F.col("x") * (h - lo)).otherwise(0.0))
    return x.groupBy(*keys).agg(value.alias("quantile"))


def mad(df: DataFrame, c: str, key: str) -> DataFrame:
    """Raw median absolute deviation by group."""
    mid = df.groupBy(key).agg(F.median(num(c)).alias("_m"))
    return df.join(mid, key).groupBy(key).agg(F.median(F.abs(num(c) - F.col("_m"))).alias("mad"))


def ranked(df: DataFrame, c: str, key: str) -> DataFrame:
    """x, r (1-based rank in the group, ties by row) and n of each value. A group's order needs its rows together."""
    w = Window.partitionBy(key)
    x = df.filter(F.col(c).isNotNull()).select(key, num(c).alias("x"))
    return x.withColumn("r", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w))


def ordered_stats(df: DataFrame, c: str, key: str, fraction: float = 0.1) -> DataFrame:
    """gini, trimmed_mean, winsorized_mean and the first three L-moments by group."""
    x = ranked(df, c, key)
    r, n = F.col("r"), F.col("n")
    cut = F.floor(n * fraction)
    bounds = x.groupBy(key).agg(F.max(F.when(r == cut + 1, F.col("x"))).alias("lo"), F.max(F.when(r == n - cut, F.col("x"))).alias("hi"))
    x = x.join(bounds, key)
    b0, b1 = F.avg("x"), F.avg(F.col("x") * F.try_divide(r - 1, n - 1))
    b2 = F.avg(F.col("x") * F.try_divide((r - 1) * (r - 2), (n - 1) * (n - 2)))
    total = F.sum("x")
    gini = F.when(total == 0, 0.0).otherwise(F.try_divide(2 * F.sum(r * F.col("x")), F.max(n) * total) - (F.max(n) + 1) / F.max(n))
    return x.groupBy(key).agg(
        gini.alias("gini"),
        F.avg(F.when((r > cut) & (r <= n - cut), F.col("x"))).alias("trimmed_mean"),
        F.avg(F.least(F.greatest(F.col("x"), F.col("lo")), F.col("hi"))).alias("winsorized_mean"),
        b0.alias("l1"), (2 * b1 - b0).alias("l2"), (6 * b2 - 6 * b1 + b0).alias("l3"),
    )


def average_ranks(df: DataFrame, c: str, out: str, key: str | None = None) -> DataFrame:
    """1-based ranks with ties averaged.

    With a key, by window. Without, values are counted first, so only distinct values are ranked, and those in ranges:
    each range's rows before it are a prefix sum over the ranges' totals.
    """
    if key:
        w = Window.partitionBy(key)
        rank = F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2.0
        return df.withColumn(out, F.when(F.col(c).isNotNull(), rank))
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
    before = running_total(counts, c, "_n", "_before")
    ranks = before.select(F.col(c).alias("_c"), (F.col("_before") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, df[c] == ranks["_c"], "left").drop("_c")


def running_total(df: DataFrame, order: str, c: str, out: str, parts: int | None = None) -> DataFrame:
    """Inclusive prefix sums over one order of the whole table, without one task of all rows.

    Rows are dealt by ranges of the order, as many as shuffles have partitions; ties are told apart by their other columns,
    so equal values may be split. A range's sum is a plain aggregate, and only the ranges' sums (one row each) are summed in
    one task.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64(*df.columns)
    dealt = df.withColumn("_t", tie).repartitionByRange(parts, order, "_t").withColumn("_p", F.spark_partition_id())
    from tessera.operators.stages import written

    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("_p").agg(F.sum(c).alias("_s"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_b"))
    inside = F.sum(c).over(Window.partitionBy("_p").orderBy(order, "_t").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, inside).join(F.broadcast(before), "_p").withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b", "_t")


def bin_stats(df: DataFrame, keys: list[str], c: str, order: list[str]) -> DataFrame:
    """count, sum, sum_sq, mean, variance (of the population; NULL up to one row), std, min, max, first and last of a bin."""
    x, at = num(c), F.struct(*order)
    many = F.count(x) > 1
    return df.groupBy(*keys).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"), F.avg(x).alias("mean"), F.when(many, F.var_pop(x)).alias("variance"), F.when(many, F.stddev_pop(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.min_by(x, at).alias("first"), F.max_by(x, at).alias("last"))


def epoch_micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a time zone (then as UTC)."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(`{ts}` AS timestamp_ntz))")


def bucket(ts: str, seconds: int) -> Column:
    """The start of a timestamp's bucket, in seconds since the epoch."""
    return (F.floor(epoch_micros(ts) / (seconds * 1_000_000)) * seconds).cast("long")


#: Cadences of roll-ups, in seconds.
CADENCES = (30, 60, 300, 900, 1800, 3600, 14400, 86400)


def roll_up(df: DataFrame, key: str, ts: str, c: str, cadences: tuple[int, ...] = CADENCES) -> DataFrame:
    """Sufficient statistics by key, cadence and bucket. Coarser buckets are made of finer ones where they nest."""
    from tessera.operators.stages import written

    def stats(rows: DataFrame, n: Column, s: Column, q: Column, lo: Column, hi: Column, start: Column) -> DataFrame:
        return rows.groupBy(key, start.alias("start")).agg(F.sum(s).alias("sum"), F.sum(q).alias("sum_sq"), F.min(lo).alias("min"), F.max(hi).alias("max"), F.sum(n).alias("count"))

    x, out = num(c), None
    levels: dict[int, DataFrame] = {}
    for size in sorted(cadences):
        finer = max((f for f in levels if size % f == 0), default=None)
        if finer is None:
            level = stats(df, F.when(x.isNotNull(), 1).otherwise(0), x, x * x, x, x, bucket(ts, size))
        else:
            level = stats(levels[finer], F.col("count"), F.col("sum"), F.col("sum_sq"), F.col("min"), F.col("max"), (F.floor(F.col("start") / size) * size).cast("long"))
        if not levels:  # the finest level feeds all others
            level = written(level, "finest")
        levels[size] = level
        part = level.withColumn("cadence", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


def ohlcv(df: DataFrame, keys: list[str], price: str, size: Column, order: list[str]) -> DataFrame:
    p, at = num(price), F.struct(*order)
    volume = F.sum(size)
    return df.groupBy(*keys).agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), volume.alias("volume"), F.when(volume > 0, F.try_divide(F.sum(p * size), volume)).alias("vwap"))


def tick_counts(df: DataFrame, keys: list[str], price: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    step = num(price) - F.lag(num(price)).over(w)
    return df.withColumn("_s", step).groupBy(*keys).agg(F.count("*").alias("tick_count"), F.count_distinct(price).alias("unique_prices"), F.count_if(F.col("_s") > 0).alias("upticks"), F.count_if(F.col("_s") < 0).alias("downticks"), F.count_if(F.col("_s") == 0).alias("unchanged"))


def histogram_entropy(df: DataFrame, c: str, bins: int, key: str) -> DataFrame:
    """Of equal-width bins over each group's range, with the width's logarithm; 0 for constant groups."""
    x = num(c)
    span = df.groupBy(key).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.least(F.floor(F.try_divide(x - F.col("lo"), width)), F.lit(bins - 1))
    cells = df.join(span, key).filter("hi > lo").groupBy(key, cell.alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first(width).alias("w"))
    p = F.col("k") / F.col("n")
    h = cells.groupBy(key).agg((F.sum(-p * F.ln(p)) + F.ln(F.first("w"))).alias("h"))
    return span.join(h, key, "left").select(key, F.coalesce("h", F.lit(0.0)).alias("entropy"))


def correlation_sums(columns: list[str]) -> list[Column]:
    """All pairwise sums of products, sums and the count, in one aggregate: what Gram and covariance matrices need."""
    out = [F.count("*").cast("double").alias("n")] + [F.sum(num(c)).alias(f"s_{i}") for i, c in enumerate(columns)]
    return out + [F.sum(num(a) * num(b)).alias(f"p_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
