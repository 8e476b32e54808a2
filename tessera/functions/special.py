"""Special functions and distributions in numpy, for arrays or numbers."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_gamma = np.vectorize(lambda x: math.gamma(x) if x > 0 or x != math.floor(x) else math.nan, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def erf(x):
    return _erf(x)


def erfc(x):
    return _erfc(x)


def gamma(x):
    return _gamma(x)


def log_gamma(x):
    return _lgamma(x)


def beta(a, b):
    return np.exp(_lgamma(a) + _lgamma(b) - _lgamma(np.add(a, b)))


def digamma(x: float) -> float:
    """By recurrence up to 10, then the asymptotic series."""
    if x <= 0 and x == math.floor(x):
        return math.nan
    if x < 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    shift = 0.0
    while x < 10:
        shift, x = shift - 1 / x, x + 1
    f = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total, x = total + 1 / (x * x), x + 1
    f = 1 / (x * x)
    return total + 1 / x + f / 2 + (f / x) * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta's continued fraction, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised."""
    if math.isnan(x) or a <= 0 or b <= 0:
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower."""
    if math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + top / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - front * h


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def solve_cdf(cdf, p: float, lo: float, hi: float) -> float:
    """The point where an increasing cdf reaches p, by bisection; bounds are widened until they hold it."""
    if math.isnan(p) or p < 0 or p > 1:
        return math.nan
    while cdf(lo) > p:
        lo = lo * 2 if lo < 0 else lo - 1
        if lo < -1e300:
            return -math.inf
    while cdf(hi) < p:
        hi = hi * 2 if hi > 0 else hi + 1
        if hi > 1e300:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    if p in (0, 1):
        return math.inf if p else -math.inf
    return solve_cdf(lambda x: float(norm_cdf(x)), p, -10.0, 10.0)


def t_cdf(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return float(t > 0)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) or df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_cdf(f: float, d1: float, d2: float) -> float:
    return 0.0 if f <= 0 else beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def chi2_cdf(x: float, df: float) -> float:
    return gamma_inc(df / 2, x / 2)


def t_ppf(p: float, df: float) -> float:
    return solve_cdf(lambda x: t_cdf(x, df), p, -50.0, 50.0)


def chi2_ppf(p: float, df: float) -> float:
    return solve_cdf(lambda x: chi2_cdf(x, df), p, 0.0, 10.0 * df + 10)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return solve_cdf(lambda x: f_cdf(x, d1, d2), p, 0.0, 100.0)


def poisson_cdf(k: int, lam: float) -> float:
    return 0.0 if k < 0 else 1 - gamma_inc(math.floor(k) + 1, lam)


def binom_pmf(k: int, n: int, p: float) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k) if 0 <= k <= n else 0.0


def binom_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_inc(n - math.floor(k), math.floor(k) + 1, 1 - p)


#: Closed-form distributions: name -> (pdf, cdf, quantile) of a point or probability and parameters.
CLOSED = {
    "exponential": (lambda x, r: r * np.exp(-r * x) * (x >= 0), lambda x, r: -np.expm1(-r * np.maximum(x, 0)), lambda p, r: -np.log1p(-p) / r),
    "weibull": (lambda x, k, s: k / s * (x / s) ** (k - 1) * np.exp(-((x / s) ** k)), lambda x, k, s: -np.expm1(-((x / s) ** k)), lambda p, k, s: s * (-np.log1p(-p)) ** (1 / k)),
    "pareto": (lambda x, a, m: a * m**a / x ** (a + 1) * (x >= m), lambda x, a, m: np.where(x >= m, 1 - (m / x) ** a, 0.0), lambda p, a, m: m * (1 - p) ** (-1 / a)),
    "cauchy": (lambda x, m, g: 1 / (math.pi * g * (1 + ((x - m) / g) ** 2)), lambda x, m, g: np.arctan((x - m) / g) / math.pi + 0.5, lambda p, m, g: m + g * np.tan(math.pi * (p - 0.5))),
    "lognormal": (lambda x, m, s: norm_pdf((np.log(x) - m) / s) / (x * s), lambda x, m, s: norm_cdf((np.log(x) - m) / s), lambda p, m, s: math.exp(m + s * norm_ppf(p))),
}


def kolmogorov_tail(d: float, n: float) -> float:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) if n > 0 else 0.0
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
