"""Queries of windows, scans and ordered series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import series, windows
from tessera.operators.aggregates import epoch_micros
from tessera.plans._queries import ORDER, PRICES, Registry, W, prices, r, t

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
_F = W[:-1]


@query(f"SELECT event_id, round(sum(value) OVER {_F} ROWS UNBOUNDED PRECEDING), 4) AS add, min(value) OVER {_F} ROWS UNBOUNDED PRECEDING) AS min, max(value) OVER {_F} ROWS UNBOUNDED PRECEDING) AS max, round(avg(value) OVER {_F} ROWS UNBOUNDED PRECEDING), 9) AS mean, round(sqrt(coalesce(var_samp(value) OVER {_F} ROWS UNBOUNDED PRECEDING), 0)), 5) AS deviation, round(sum(value - 10) OVER {_F} ROWS UNBOUNDED PRECEDING), 4) AS centred FROM events")
def scans(spark, sf_dir):
    w = windows.ordered("user_id", ORDER)
    s = lambda op, **k: windows.scan(op, "value", w, **k)
    return t(spark, sf_dir, "events").select("event_id", r(s("add"), 4).alias("add"), s("min").alias("min"), s("max").alias("max"), r(s("mean"), 9).alias("mean"), r(F.sqrt(s("variance")), 5).alias("deviation"), r(s("centred", ref=10.0), 4).alias("centred"))


_R = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, round(m, 6) AS value_mean_20, round(s, 4) AS value_std_20, round(CASE WHEN s > 1e-12 THEN (value - m) / s ELSE 0 END, 4) AS value_zscore_20 FROM (SELECT event_id, value, avg(value) OVER {_F} {_R} AS m, stddev_pop(value) OVER {_F} {_R} AS s FROM events)")
def rolling_pipeline(spark, sf_dir):
    p = windows.Pipeline(t(spark, sf_dir, "events"), "user_id", ORDER).rolling_mean("value").rolling_std("value").rolling_zscore("value").execute()
    return p.select("event_id", r("value_mean_20").alias("value_mean_20"), r("value_std_20", 4).alias("value_std_20"), r("value_zscore_20", 4).alias("value_zscore_20"))


@query(f"SELECT event_id, round(v, 4) AS variance FROM (SELECT event_id, var_pop(value) OVER {_F} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v, row_number() OVER {W} AS i FROM events) WHERE i >= 5")
def rolling_variance_full(spark, sf_dir):
    return windows.rolling_variance_full(t(spark, sf_dir, "events"), "value", "user_id", ORDER, 5).select("event_id", r("variance", 4).alias("variance"))


@query(f"SELECT event_id, round(avg(value) OVER {_F} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS average, round(quantile_cont(value, 0.5) OVER {_F} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS middle FROM events")
def centred_filters(spark, sf_dir):
    w = windows.ordered("user_id", ORDER)
    return t(spark, sf_dir, "events").select("event_id", r(windows.moving_average("value", w, 5)).alias("average"), r(windows.median_filter("value", w, 5)).alias("middle"))


@query(f"SELECT event_id, round(p - q, 6) AS value, round(ln(p) - ln(q), 6) AS log, round((p - q) / q, 9) AS percent, sign(p - q)::DOUBLE AS direction FROM (SELECT event_id, price AS p, lag(price, 2) OVER {W} AS q FROM {PRICES})")
def lag_transforms(spark, sf_dir):
    w = windows.ordered("user_id", ORDER)
    return prices(spark, sf_dir).select("event_id", *[(r(windows.lag_transform(k, "price", w, 2), 9 if k == "percent" else 6) if k != "direction" else windows.lag_transform(k, "price", w, 2)).alias(k) for k in ("value", "log", "percent", "direction")])


@query(f"SELECT event_id, round(ln(price / q), 8) AS log_return, round(price / q - 1, 8) AS simple_return FROM (SELECT event_id, price, lag(price) OVER {W} AS q FROM {PRICES}) WHERE q IS NOT NULL")
def returns(spark, sf_dir):
    w = windows.ordered("user_id", ORDER)
    x = prices(spark, sf_dir).select("event_id", r(windows.log_return("price", w), 8).alias("log_return"), r(windows.simple_return("price", w), 8).alias("simple_return"))
    return x.filter("simple_return IS NOT NULL")


@query(f"""WITH n AS (SELECT event_id, price AS x, coalesce(lag(price, 1) OVER {W}, price) AS a, coalesce(lead(price, 1) OVER {W}, price) AS b FROM {PRICES})
SELECT event_id, round((a + b) / 2, 6) AS mean, round(abs(a - b) / 2, 6) AS std, round((b - a) / 2, 6) AS slope, CASE WHEN x > greatest(a, b) THEN 1 WHEN x < least(a, b) THEN -1 ELSE 0 END AS peak, round(x - a, 6) AS delta, round(ln(x / b), 6) AS log_ratio FROM n""")
def local_context(spark, sf_dir):
    f = windows.local_context("price", windows.ordered("user_id", ORDER), [-1, 1])
    return prices(spark, sf_dir).select("event_id", r(f["mean"]).alias("mean"), r(f["std"]).alias("std"), r(f["slope"]).alias("slope"), f["peak"].alias("peak"), r(f["delta_-1"]).alias("delta"), r(f["log_ratio_1"]).alias("log_ratio"))


@query(f"SELECT user_id, round(max((top - price) / top), 8) AS max_drawdown FROM (SELECT user_id, price, max(price) OVER {_F} ROWS UNBOUNDED PRECEDING) AS top FROM {PRICES}) GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return windows.max_drawdown(prices(spark, sf_dir), "price", "user_id", ORDER).select("user_id", r("max_drawdown", 8).alias("max_drawdown"))


@query(f"WITH x AS (SELECT user_id, price, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {PRICES}) SELECT user_id, round(sum(price * power(0.7, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END), 5) AS ema, round(0.3 * sum(price * power(0.7, n - i)) / sum(power(0.7, n - i)), 5) AS ewm, round(sum(price * 0.2 * power(0.9, n - i)), 5) AS affine FROM x GROUP BY 1")
def linear_recurrences(spark, sf_dir):
    s = windows.series(prices(spark, sf_dir), "price", "user_id", ORDER)
    x = F.col("series")
    return s.select("user_id", r(windows.ema(x, 0.3), 5).alias("ema"), r(windows.ewm(x, 0.3), 5).alias("ewm"), r(windows.affine_scan(x, 0.9, 0.2), 5).alias("affine"))


@query("WITH RECURSIVE x AS (SELECT user_id, price, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM " + PRICES + "), h(user_id, i, n, l, b) AS (SELECT x.user_id, 1, x.n, x.price, y.price - x.price FROM x LEFT JOIN x y ON y.user_id = x.user_id AND y.i = 2 WHERE x.i = 1 UNION ALL SELECT h.user_id, h.i + 1, h.n, 0.3 * x.price + 0.7 * (h.l + h.b), 0.1 * (0.3 * x.price + 0.7 * (h.l + h.b) - h.l) + 0.9 * h.b FROM h JOIN x ON x.user_id = h.user_id AND x.i = h.i + 1) SELECT user_id, round(l + 10 * b, 4) AS forecast FROM h WHERE i = n")
def holt_forecast(spark, sf_dir):
    s = windows.series(prices(spark, sf_dir), "price", "user_id", ORDER)
    return s.select("user_id", r(windows.holt(F.col("series"), 0.3, 0.1, 10), 4).alias("forecast"))


@query()
def kalman(spark, sf_dir):
    s = windows.series(prices(spark, sf_dir), "price", "user_id", ORDER)
    k = windows.kalman_scalar(F.col("series"), 1.0, 1.0, 0.01, 1.0)
    return s.select("user_id", r(windows.kalman_filter(F.col("series"))).alias("steady"), r(k["x"]).alias("state"), r(k["p"]).alias("variance"))


@query(f"""WITH a AS (SELECT user_id, ts, event_id, ln(price / lag(price) OVER {W}) AS r FROM {PRICES}), b AS (SELECT user_id, r, lag(r) OVER {W} AS q FROM a),
s AS (SELECT user_id, coalesce(sum(r * r), 0) AS rv, coalesce(pi() / 2 * sum(abs(r) * abs(q)), 0) AS bv, count(r) AS n FROM b GROUP BY 1)
SELECT user_id, n, round(rv, 6) AS realized_variance, round(bv, 6) AS bipower_variation, round(sqrt(rv), 6) AS realized_volatility, round(CASE WHEN rv > 1e-15 THEN greatest(rv - bv, 0) / rv END, 6) AS jump_ratio FROM s""")
def realized_measures(spark, sf_dir):
    m = series.realized(prices(spark, sf_dir), "user_id", ORDER, "price")
    return m.select("user_id", "n", *[r(c).alias(c) for c in ("realized_variance", "bipower_variation", "realized_volatility", "jump_ratio")])


@query("WITH d AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), s AS (SELECT event_type, sum(d * d) AS s FROM d GROUP BY 1) SELECT a.event_type, k AS lag, round(sum(a.d * b.d) / any_value(s), 6) AS acf FROM range(6) x(k) JOIN d a ON true JOIN d b ON a.event_type = b.event_type AND b.i = a.i + k JOIN s ON s.event_type = a.event_type GROUP BY ALL")
def autocorrelation(spark, sf_dir):
    a = series.acf(t(spark, sf_dir, "events"), "event_type", ORDER, "value", 5)
    return a.select("event_type", F.col("lag").cast("long").alias("lag"), r("acf").alias("acf"))


@query("SELECT event_id, round(epoch_us(ts) % 86400000000 / 1e6, 6) AS seconds, round(sin(epoch_us(ts) % 86400000000 / 1e6 / 86400 * 2 * pi()), 8) AS s, round(cos(epoch_us(ts) % 86400000000 / 1e6 / 86400 * 2 * pi()), 8) AS c FROM events")
def time_of_day(spark, sf_dir):
    ns = epoch_micros("ts") * 1000
    s, c = windows.time_of_day(ns)
    return t(spark, sf_dir, "events").select("event_id", r(windows.seconds_of_day(ns)).alias("seconds"), r(s, 8).alias("s"), r(c, 8).alias("c"))


@query(f"""WITH p AS (SELECT user_id, CASE WHEN a <= b AND b <= c THEN 'abc' WHEN a <= c AND c < b THEN 'acb' WHEN b < a AND a <= c THEN 'bac' WHEN b <= c AND c < a THEN 'bca' WHEN c < a AND a <= b THEN 'cab' ELSE 'cba' END AS k FROM (SELECT user_id, lag(value, 2) OVER {W} AS a, lag(value) OVER {W} AS b, value AS c, row_number() OVER {W} AS i FROM events) WHERE i > 2),
n AS (SELECT user_id, k, count(*)::DOUBLE AS n FROM p GROUP BY ALL) SELECT user_id, round(-sum(n / t * ln(n / t)) + 0.0, 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM n) GROUP BY 1""")
def permutation_entropy(spark, sf_dir):
    x = series.apply(t(spark, sf_dir, "events"), "user_id", ORDER, ["value"], kernels.permutation_entropy, ["entropy"])
    return x.filter(~F.isnan("entropy")).select("user_id", r("entropy").alias("entropy"))


@query()
def complexity(spark, sf_dir):
    return series.summary(t(spark, sf_dir, "events"), "user_id", ORDER, "value")


@query()
def spectral_summary(spark, sf_dir):
    return series.apply(t(spark, sf_dir, "events"), "user_id", ORDER, ["value"], kernels.spectral_summary, ["centroid", "bandwidth", "entropy", "peak"])


def _volatility(p: np.ndarray) -> dict:
    ret = np.diff(np.log(p))
    return kernels.garch(ret, 30) | kernels.jarque_bera(ret) if len(ret) >= 10 else {}


@query()
def garch(spark, sf_dir):
    return series.apply(prices(spark, sf_dir), "user_id", ORDER, ["price"], _volatility, ["omega", "alpha", "beta", "loglik", "statistic", "p"])


def _stationarity(x: np.ndarray) -> dict:
    return {"adf": kernels.adf(x, 2), "kpss": kernels.kpss(x), "ljung_box": kernels.ljung_box(x, 5)["statistic"] if len(x) > 12 else math.nan, "cusum": kernels.cusum(x)["statistic"]}


@query()
def stationarity(spark, sf_dir):
    return series.apply(t(spark, sf_dir, "events"), "user_id", ORDER, ["value"], _stationarity, ["adf", "kpss", "ljung_box", "cusum"])


@query()
def partial_autocorrelation(spark, sf_dir):
    return series.vectors(t(spark, sf_dir, "events"), "user_id", ORDER, "value", lambda x: kernels.pacf(x, 5) if len(x) > 6 else [])


@query()
def change_points(spark, sf_dir):
    return series.vectors(t(spark, sf_dir, "events"), "user_id", ORDER, "value", kernels.bocpd)


@query()
def robust_locations(spark, sf_dir):
    return series.apply(t(spark, sf_dir, "events"), "user_id", ORDER, ["value"], lambda x: {"huber": kernels.m_estimate(x), "bisquare": kernels.m_estimate(x, "bisquare", 4.685)}, ["huber", "bisquare"])


@query("SELECT event_type, floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_buckets(spark, sf_dir):
    """The batch form of the streamed buckets; tests hold the stream against it."""
    from tessera.streaming.buckets import bucketed

    b = bucketed(t(spark, sf_dir, "events"), "1 hour")
    return b.select("event_type", (epoch_micros("start") / 1_000_000).cast("long").alias("start"), "n", r("total", 4).alias("total"))
