"""Divergences between two columns of probabilities, as aggregate expressions; values are taken as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.exprs import INF, num


def _log_ratio(p: Column, q: Column) -> Column:
    """p ln(p/q): 0 where p is 0, infinite where only q is."""
    return F.when(p <= 0, 0.0).when(q <= 0, F.lit(INF)).otherwise(p * F.ln(F.when((p > 0) & (q > 0), p / F.when(q > 0, q))))


def kl(p, q) -> Column:
    return F.sum(_log_ratio(num(p), num(q)))


def js(p, q) -> Column:
    p, q = num(p), num(q)
    m = (p + q) / 2
    return 0.5 * F.sum(_log_ratio(p, m)) + 0.5 * F.sum(_log_ratio(q, m))


def cross_entropy(p, q) -> Column:
    p, q = num(p), num(q)
    return -F.sum(F.when(p <= 0, 0.0).when(q <= 0, F.lit(-INF)).otherwise(p * F.ln(F.when(q > 0, q))))


def hellinger(p, q) -> Column:
    d = F.sqrt(num(p)) - F.sqrt(num(q))
    return F.sqrt(F.sum(d * d) / 2)


def total_variation(p, q) -> Column:
    return F.sum(F.abs(num(p) - num(q))) / 2


def chi_squared(p, q) -> Column:
    p, q = num(p), num(q)
    return F.sum(F.when(q > 0, (p - q) * (p - q) / F.when(q > 0, q)).when(F.abs(p - q) < 1e-300, 0.0).otherwise(F.lit(INF)))


def renyi(p, q, alpha: float) -> Column:
    if abs(alpha - 1) < 1e-12:
        return kl(p, q)
    p, q = num(p), num(q)
    s = F.sum(F.when(p <= 0, 0.0).when(q <= 0, F.lit(INF)).otherwise(F.pow(p, F.lit(alpha)) * F.pow(q, F.lit(1.0 - alpha))))
    return F.when(s == INF, F.lit(INF)).otherwise(F.ln(s) / (alpha - 1))


def bhattacharyya(p, q) -> Column:
    bc = F.sum(F.sqrt(F.greatest(num(p), F.lit(0.0)) * F.greatest(num(q), F.lit(0.0))))
    return F.when(bc <= 0, F.lit(INF)).otherwise(-F.ln(F.when(bc > 0, bc)))
