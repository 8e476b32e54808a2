"""Statistics of one or two samples (numpy arrays without NaN): ranks, scales, densities, entropies, resampling."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import kernels as kn
from tessera.functions import special as sp

NAN = math.nan


def two_sided(z: float) -> float:
    return float(2 * sp.norm_cdf(-abs(z)))


# moments and corrections


def l_moments(x: np.ndarray) -> dict:
    """The first four L-moments from probability-weighted moments, and the ratios of the last two."""
    v, n = np.sort(x), len(x)
    if n < 4:
        return {"l1": NAN, "l2": NAN, "l3": NAN, "l4": NAN, "skewness": NAN, "kurtosis": NAN}
    i = np.arange(n, dtype=float)
    w, b = np.ones(n), []
    for r in range(4):
        b.append(float((w * v).mean()))
        w = w * (i - r) / (n - 1 - r)
    l2, l3, l4 = 2 * b[1] - b[0], 6 * b[2] - 6 * b[1] + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    return {"l1": b[0], "l2": l2, "l3": l3, "l4": l4, "skewness": l3 / l2 if l2 else NAN, "kurtosis": l4 / l2 if l2 else NAN}


def adjusted(p: np.ndarray, how: str) -> np.ndarray:
    """Bonferroni, Holm's step-down or Benjamini and Hochberg's step-up correction, in the order of p."""
    m = len(p)
    if how == "bonferroni":
        return np.minimum(p * m, 1.0)
    order = np.argsort(p, kind="stable")
    out = np.empty(m)
    if how == "holm":
        out[order] = np.minimum(np.maximum.accumulate(p[order] * np.arange(m, 0, -1)), 1.0)
    else:
        out[order] = np.minimum(np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1], 1.0)
    return out


# association


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    a, b = x - x.mean(), y - y.mean()
    d = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / d if d > 0 else NAN


def phi(x: np.ndarray, y: np.ndarray) -> float:
    """Of two columns cut at one half."""
    return pearson((x > 0.5).astype(float), (y > 0.5).astype(float))


def biserial(binary: np.ndarray, y: np.ndarray) -> float:
    one = binary > 0.5
    s = y.std()
    if one.all() or not one.any() or s < 1e-15:
        return NAN
    p = one.mean()
    return float((y[one].mean() - y[~one].mean()) / s * p * (1 - p) / sp.norm_pdf(sp.norm_ppf(1 - p)))


def u_statistic(x: np.ndarray, y: np.ndarray) -> float:
    """Pairs in which x is larger, ties by half."""
    return float(kn.average_ranks(np.concatenate([x, y]))[: len(x)].sum() - len(x) * (len(x) + 1) / 2)


def rank_biserial(x: np.ndarray, y: np.ndarray) -> float:
    """From the smaller of the two U statistics."""
    n = len(x) * len(y)
    u = u_statistic(x, y) if n else NAN
    return 1 - 2 * min(u, n - u) / n if n else NAN


def distance_sums(v: np.ndarray) -> np.ndarray:
    """Each value's sum of distances to all."""
    order, n = np.argsort(v, kind="stable"), len(v)
    t, k = v[order], np.arange(n)
    below = np.cumsum(t) - t
    out = np.empty(n)
    out[order] = t * k - below + (t.sum() - below - t) - t * (n - 1 - k)
    return out


def distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """The sum over pairs (both ways) of the products of their distances: for each row, sums over rows before it by x and below it by y."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    rank = np.empty(len(x), np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(len(x))
    parts = np.stack([np.ones(len(x)), x, y, x * y])
    under = np.zeros(parts.shape)
    for at, second, first in kn.merged(rank):
        for part, sums in zip(parts, under, strict=True):
            sums[at[second]] += kn.before(np.cumsum(np.where(second, 0.0, part[at])), first)[second]
    under = 2 * under - (np.cumsum(parts, axis=1) - parts)
    return 2 * float((x * y * under[0] - y * under[1] - x * under[2] + under[3]).sum())


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) > kn.DIRECT:
        n, x, y = len(x), x - x.mean(), y - y.mean()
        a, b = distance_sums(x), distance_sums(y)
        mean = lambda s, p, q: s / n**2 - 2 * float((p / n * (q / n)).mean()) + float(p.mean() / n * (q.mean() / n))
        va, vb = (mean(2 * n * float(v @ v) - 2 * float(v.sum()) ** 2, p, p) for v, p in ((x, a), (y, b)))
        ab = mean(distance_products(x, y), a, b)
        return math.sqrt(max(ab, 0.0) / math.sqrt(va * vb)) if va > 0 and vb > 0 else 0.0

    def centred(v):
        d = np.abs(v[:, None] - v[None])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    va, vb = float((a * a).mean()), float((b * b).mean())
    return math.sqrt(max(float((a * b).mean()), 0.0) / math.sqrt(va * vb)) if va > 0 and vb > 0 else 0.0


def concordance(x: np.ndarray, y: np.ndarray) -> float:
    return float(2 * ((x - x.mean()) * (y - y.mean())).mean() / (x.var() + y.var() + (x.mean() - y.mean()) ** 2))


def cramers_v(table: np.ndarray) -> float:
    n = table.sum()
    expected = table.sum(1, keepdims=True) * table.sum(0) / n
    live = expected > 0
    chi2 = float((((table - expected) ** 2)[live] / expected[live]).sum())
    k = min(table.shape) - 1
    return math.sqrt(chi2 / (n * k)) if k > 0 else NAN


def tetrachoric(a: float, b: float, c: float, d: float) -> float:
    """The cosine approximation for a table of two binary variables."""
    if b * c < 1e-15:
        return 1.0 if a * d > b * c else NAN
    return math.cos(math.pi / (1 + math.sqrt(a * d / (b * c))))


def icc(x: np.ndarray, groups: np.ndarray) -> float:
    """One-way intraclass correlation, with the harmonic group size that unequal groups call for."""
    _, g = np.unique(groups, return_inverse=True)
    n, k = np.bincount(g), g.max() + 1
    if k < 2 or len(x) <= k:
        return NAN
    means = np.bincount(g, x) / n
    between = float((n * (means - x.mean()) ** 2).sum()) / (k - 1)
    within = float(((x - means[g]) ** 2).sum()) / (len(x) - k)
    n0 = (len(x) - float((n * n).sum()) / len(x)) / (k - 1)
    d = between + (n0 - 1) * within
    return (between - within) / d if d else NAN


# tests


def shapiro_wilk(x: np.ndarray) -> dict:
    """W by Royston's approximation of the weights, and its p value."""
    n = len(x)
    v = np.sort(x)
    if n < 3 or v[-1] - v[0] < 1e-300:
        return {"statistic": NAN, "p": NAN}
    m = np.array([sp.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    a = c.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            f = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(f)
            a[[0, 1, -2, -1]] = -last, -second, second, last
        else:
            f = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(f)
            a[[0, -1]] = -last, last
    d = v - v.mean()
    w = min(float(a @ v) ** 2 / float(d @ d), 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return {"statistic": w, "p": max(p, 0.0)}
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return {"statistic": w, "p": 0.0}
        y = -math.log(g - y)
        mu, s = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, s = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return {"statistic": w, "p": float(1 - sp.norm_cdf((y - mu) / s))}


def dagostino(x: np.ndarray) -> dict:
    """The omnibus of the skewness and kurtosis tests."""
    z1, z2 = kn.skewtest(x), kn.kurtosistest(x)
    k = z1 * z1 + z2 * z2
    return {"statistic": k, "p": float(1 - sp.chi2_cdf(k, 2)) if k == k else NAN}


def normality(x: np.ndarray, threshold: int = 5000) -> float:
    """The p value of Shapiro and Wilk's test below the threshold, D'Agostino's from it on."""
    return NAN if len(x) < 3 else (shapiro_wilk(x) if len(x) < threshold else dagostino(x))["p"]


def rank_sums(x: np.ndarray, y: np.ndarray) -> dict:
    n, m = len(x), len(y)
    w = float(kn.average_ranks(np.concatenate([x, y]))[:n].sum())
    z = (w - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return {"statistic": z, "p": two_sided(z)}


def sign_test(x: np.ndarray, median: float = 0.0) -> dict:
    return sign_counts(int((x > median).sum()), int((x < median).sum()))


def sign_counts(up: int, down: int) -> dict:
    n = up + down
    return {"statistic": float(up), "p": two_sided((up - n / 2) / math.sqrt(n / 4))} if n else {"statistic": NAN, "p": NAN}


def runs_test(x: np.ndarray) -> dict:
    """Runs above and not above the median."""
    above = x > np.median(x)
    n1, n0 = int(above.sum()), int((~above).sum())
    n, runs = n1 + n0, 1 + int((above[1:] != above[:-1]).sum())
    if not n1 or not n0:
        return {"statistic": float(runs), "p": NAN}
    mean, var = 2 * n1 * n0 / n + 1, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    return {"statistic": float(runs), "p": two_sided((runs - mean) / math.sqrt(var)) if var > 0 else NAN}


def ks_normal(x: np.ndarray) -> dict:
    """Against the standard normal."""
    v, n = np.sort(x), len(x)
    if not n:
        return {"statistic": NAN, "p": NAN}
    f = np.array([sp.norm_cdf(t) for t in v], float)
    d = float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))
    return {"statistic": d, "p": float(sp.kolmogorov_tail(d, n))}


def welch_anova_of(n: np.ndarray, m: np.ndarray, v: np.ndarray) -> dict:
    """From the groups' sizes, means and variances."""
    k, w = len(n), n / v
    grand = float((w * m).sum() / w.sum())
    lam = float(((1 - w / w.sum()) ** 2 / (n - 1)).sum())
    f = float((w * (m - grand) ** 2).sum()) / (k - 1) / (1 + 2 * (k - 2) * lam / (k * k - 1))
    df = (k * k - 1) / (3 * lam)
    return {"statistic": f, "df_between": k - 1, "df_within": df, "p": float(1 - sp.f_cdf(f, k - 1, df))}


def bootstrap(x: np.ndarray, n: int = 1000, level: float = 0.95, seed: int = 42) -> dict:
    """The mean with percentile bounds of its resamples."""
    r = np.random.default_rng(seed)
    means = np.array([x[r.integers(0, len(x), len(x))].mean() for _ in range(n)])
    lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return {"estimate": float(x.mean()), "lower": float(lo), "upper": float(hi), "se": float(means.std(ddof=1))}


def permutation_test(x: np.ndarray, y: np.ndarray, n: int = 5000, seed: int = 42) -> dict:
    """The difference of means among random splits of both."""
    r, both = np.random.default_rng(seed), np.concatenate([x, y])
    d, extreme = float(x.mean() - y.mean()), 0
    for _ in range(n):
        r.shuffle(both)
        extreme += abs(both[: len(x)].mean() - both[len(x) :].mean()) >= abs(d) - 1e-15
    return {"statistic": d, "p": (extreme + 1) / (n + 1)}


# slopes, scales and densities


def siegel(y: np.ndarray, x: np.ndarray | None = None) -> dict:
    """Repeated medians: of each point's slopes to the others, then of these."""
    x = np.arange(len(y), dtype=float) if x is None else x
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (y[None] - y[:, None]) / (x[None] - x[:, None])
    s[~np.isfinite(s)] = NAN
    slope = float(np.median(np.nanmedian(s, 1)))
    return {"slope": slope, "intercept": float(np.median(y - slope * x))}


def qn_scale(x: np.ndarray) -> float:
    n = len(x)
    if n < 2:
        return 0.0
    d = np.sort(np.abs(x[:, None] - x[None])[np.triu_indices(n, 1)])
    h = n // 2 + 1
    # finite-sample factors (fixed values) for up to nine points, then by parity
    small = {2: 0.399, 3: 0.994, 4: 0.512, 5: 0.844, 6: 0.611, 7: 0.857, 8: 0.669, 9: 0.872}
    factor = small.get(n, n / (n + 1.4) if n % 2 else n / (n + 3.8))
    return float(2.2191 * factor * d[min(h * (h - 1) // 2, len(d)) - 1])


def sn_scale(x: np.ndarray) -> float:
    return 0.0 if len(x) < 2 else float(1.1926 * np.median(np.median(np.abs(x[:, None] - x[None]), 1)))


def medcouple(x: np.ndarray) -> float:
    """The median of the kernel over pairs on both sides of the median."""
    z = np.sort(x)[::-1] - np.median(x)
    up, low = z[z >= 0], z[z <= 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (up[:, None] + low[None]) / (up[:, None] - low[None])
    k = int((z == 0).sum())
    if k:  # pairs of medians are told by their places
        i, j = np.arange(k)[:, None], np.arange(k)[None]
        h[len(up) - k :, :k] = np.sign(k - 1 - i - j)
    return float(np.median(h))


def lts(x: np.ndarray, y: np.ndarray, trials: int = 500, seed: int = 42) -> dict:
    """Least trimmed squares of a line: random pairs, two concentration steps each, then the best one's to the end."""
    n = len(x)
    h, r, best = (n + 3) // 2, np.random.default_rng(seed), (math.inf, 0.0, 0.0)

    def concentrate(a: float, b: float) -> tuple[float, float, float]:
        e = (y - a - b * x) ** 2
        keep = np.argsort(e, kind="stable")[:h]
        u, v = x[keep], y[keep]
        d = float(((u - u.mean()) ** 2).sum())
        b = float(((u - u.mean()) * (v - v.mean())).sum()) / d if d > 0 else 0.0
        a = float(v.mean() - b * u.mean())
        return float(np.sort((y - a - b * x) ** 2)[:h].sum()), a, b

    for _ in range(trials):
        i, j = r.choice(n, 2, replace=False)
        if x[i] == x[j]:
            continue
        b = (y[j] - y[i]) / (x[j] - x[i])
        fit = (math.inf, y[i] - b * x[i], b)
        for _ in range(2):
            fit = concentrate(fit[1], fit[2])
        best = min(best, fit)
    for _ in range(20):
        best = min(best, concentrate(best[1], best[2]))
    return {"intercept": float(best[1]), "slope": float(best[2])}


def silverman(x: np.ndarray) -> float:
    q1, q3 = np.quantile(x, [0.25, 0.75])
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    spread = min(s, (q3 - q1) / 1.34) if q3 > q1 else s
    return 0.9 * spread * len(x) ** -0.2


def kde(x: np.ndarray, points: int = 256, width: float | None = None) -> np.ndarray:
    """(grid, density) of a Gaussian kernel, by linear binning and one convolution."""
    h = silverman(x) if width is None else width
    if not len(x) or points < 2 or not h > 0:
        return np.empty((0, 2))
    lo, hi = x.min() - 3 * h, x.max() + 3 * h
    step = (hi - lo) / (points - 1)
    at = (x - lo) / step
    k = np.minimum(at.astype(np.int64), points - 2)
    part = at - k
    counts = np.bincount(k, 1 - part, points) + np.bincount(k + 1, part, points)
    reach = np.arange(-points + 1, points) * step
    kernel = np.exp(-0.5 * (reach / h) ** 2) / (h * math.sqrt(2 * math.pi))
    size = 1 << int(3 * points).bit_length()
    density = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel, size), size)[points - 1 : 2 * points - 1] / len(x)
    return np.stack([lo + step * np.arange(points), np.maximum(density, 0.0)], 1)


# information


def entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def histogram_entropy(x: np.ndarray, bins: int = 10) -> float:
    """Entropy of equal bins plus the logarithm of their width; 0 for a constant."""
    if not len(x):
        return NAN
    lo, hi = x.min(), x.max()
    if lo == hi:
        return 0.0
    width = (hi - lo) / bins
    return entropy_of(np.bincount(np.minimum(((x - lo) / width).astype(np.int64), bins - 1))) + math.log(width)


def rounded_bins(x: np.ndarray, bins: int) -> np.ndarray:
    lo = x.min()
    scaled = (x - lo) / max(x.max() - lo, 1e-15) * (bins - 1)
    return np.minimum(np.floor(scaled + 0.5).astype(np.int64), bins - 1)


def joint_counts(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    return np.bincount(rounded_bins(x, bins) * bins + rounded_bins(y, bins), minlength=bins * bins).reshape(bins, bins)


def joint_entropy(x: np.ndarray, y: np.ndarray, bins: int = 10) -> float:
    return entropy_of(joint_counts(x, y, bins).ravel())


def mutual_information(table: np.ndarray) -> float:
    return entropy_of(table.sum(0)) + entropy_of(table.sum(1)) - entropy_of(table.ravel())


def pmi(x: np.ndarray, y: np.ndarray, bins: int = 10, positive: bool = False) -> np.ndarray:
    p = joint_counts(x, y, bins) / len(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))
    out[p == 0] = 0.0 if positive else -math.inf
    return np.maximum(out, 0.0) if positive else out


def mmd_rbf(x: np.ndarray, y: np.ndarray, bandwidth: float | None = None) -> float:
    """The unbiased squared discrepancy; the width is the median distance of the first fifty points unless given."""
    n, m = len(x), len(y)
    if n < 2 or m < 2:
        return NAN
    if bandwidth is None:
        f = x[: min(n, 50)]
        d = np.sort(((f[:, None] - f[None]) ** 2)[np.triu_indices(len(f), 1)])
        s2 = max(d[len(d) // 2] / 2, 1e-10)
    else:
        s2 = bandwidth**2
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2) / (2 * s2))
    return float((k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean())


def energy_distance(x: np.ndarray, y: np.ndarray) -> float:
    """Twice the integral of the squared difference of the distributions."""
    if not len(x) or not len(y):
        return NAN
    x, y = np.sort(x), np.sort(y)
    grid = np.sort(np.concatenate([x, y]))
    f, g = (np.searchsorted(v, grid[:-1], "right") / len(v) for v in (x, y))
    return float(2 * ((f - g) ** 2 * np.diff(grid)).sum())
