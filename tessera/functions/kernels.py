"""Kernels on one ordered series (a numpy array) or two: what windows and aggregates cannot say.

Each takes finite arrays and returns a number, a dict of numbers, or an array. Too short a series gives NaN.
"""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import special as sp

NAN = math.nan


# autocorrelation and linear models


def acf(x: np.ndarray, max_lag: int = 20) -> np.ndarray:
    """Lags 0..max_lag; all 1 for a constant series."""
    d = x - x.mean()
    total = float(d @ d)
    if total / len(x) < 1e-15:
        return np.ones(min(max_lag, len(x) - 1) + 1)
    return np.array([d[: len(d) - k] @ d[k:] / total for k in range(min(max_lag, len(x) - 1) + 1)])


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, relative innovation variance and reflections from autocorrelations."""
    a, v, k = np.zeros(order), 1.0, np.zeros(order)
    for m in range(order):
        k[m] = (r[m + 1] - a[:m] @ r[m:0:-1]) / v if v > 0 else 0.0
        a[:m], a[m] = a[:m] - k[m] * a[:m][::-1], k[m]
        v *= 1 - k[m] ** 2
    return a, v, k


def pacf(x: np.ndarray, max_lag: int = 20) -> np.ndarray:
    r = acf(x, max_lag)
    return np.append(1.0, levinson(r, len(r) - 1)[2])


def ar_fit(x: np.ndarray, p: int = 3) -> dict:
    """Yule-Walker; aic and bic of the innovation variance."""
    n = len(x)
    if n <= p + 1:
        return {"coefficients": np.full(p, NAN), "sigma2": NAN, "aic": NAN, "bic": NAN}
    a, v, _ = levinson(acf(x, p), p)
    s2 = v * x.var()
    fit = n * math.log(s2) if s2 > 0 else NAN
    return {"coefficients": a, "sigma2": s2, "aic": fit + 2 * p, "bic": fit + p * math.log(n)}


def ols(design: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors, residuals."""
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    e = y - design @ b
    df = len(y) - design.shape[1]
    cov = np.linalg.pinv(design.T @ design) * (float(e @ e) / df if df > 0 else NAN)
    return b, np.sqrt(np.maximum(np.diag(cov), 0)), e


def adf(x: np.ndarray, lags: int = 5) -> float:
    """The t statistic of the lagged level, with a constant and lagged differences."""
    d = np.diff(x)
    n = len(d) - lags
    if n <= lags + 3:
        return NAN
    design = np.column_stack([np.ones(n), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    b, se, _ = ols(design, d[lags:])
    return float(b[1] / se[1]) if se[1] > 0 else NAN


def kpss(x: np.ndarray, lags: int | None = None) -> float:
    n = len(x)
    if n < 3:
        return NAN
    e = x - x.mean()
    lags = int(4 * (n / 100) ** 0.25) if lags is None else lags
    s2 = float(e @ e) / n + 2 / n * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float(np.square(np.cumsum(e)).sum() / (n * n * s2)) if s2 > 0 else NAN


def ljung_box(x: np.ndarray, lags: int = 10) -> dict:
    n, r = len(x), acf(x, lags)[1:]
    q = n * (n + 2) * sum(v * v / (n - k - 1) for k, v in enumerate(r))
    return {"statistic": float(q), "p": 1 - sp.chi2_cdf(float(q), len(r))}


def ses(x: np.ndarray, alpha: float = 0.3) -> np.ndarray:
    out = np.empty(len(x))
    level = x[0]
    for i, v in enumerate(x):
        level = alpha * v + (1 - alpha) * level
        out[i] = level
    return out


# spectra


def periodogram(x: np.ndarray, fs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    f = np.fft.rfft(x)
    power = np.abs(f) ** 2 / (len(x) * fs)
    power[1 : None if len(x) % 2 else -1] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), power


def welch(x: np.ndarray, segment: int = 256, overlap: int | None = None, fs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    segment = min(segment, len(x))
    step = segment - (segment // 2 if overlap is None else overlap)
    window = np.hanning(segment + 1)[:-1] if segment > 1 else np.ones(1)
    parts = [np.abs(np.fft.rfft(x[a : a + segment] * window)) ** 2 for a in range(0, len(x) - segment + 1, max(step, 1))]
    power = np.mean(parts, 0) / (fs * np.square(window).sum())
    power[1 : None if segment % 2 else -1] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), power


def spectral_summary(x: np.ndarray) -> dict:
    f, p = periodogram(x - x.mean())
    total = p.sum()
    if total <= 0:
        return {"centroid": NAN, "bandwidth": NAN, "entropy": NAN, "peak": NAN}
    w = p / total
    c = float(f @ w)
    live = w[w > 0]
    return {"centroid": c, "bandwidth": float(math.sqrt(((f - c) ** 2) @ w)), "entropy": float(-(live * np.log(live)).sum()), "peak": float(f[p.argmax()])}


def envelope(x: np.ndarray) -> np.ndarray:
    """Of the analytic signal."""
    n, f = len(x), np.fft.fft(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(f * h))


def haar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x[: len(x) // 2 * 2]
    return (x[::2] + x[1::2]) / math.sqrt(2), (x[::2] - x[1::2]) / math.sqrt(2)


def savgol(x: np.ndarray, window: int = 5, order: int = 2) -> np.ndarray:
    """Local polynomial smoothing; the ends are read from the first and last fits."""
    half = window // 2
    if len(x) < window:
        return x.copy()
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    hat = basis @ np.linalg.pinv(basis)
    rows = np.lib.stride_tricks.sliding_window_view(x, window)
    return np.concatenate([hat[:half] @ rows[0], rows @ hat[half], hat[half + 1 :] @ rows[-1]])


# complexity


def _embedded(x: np.ndarray, m: int, tau: int = 1) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (m - 1) * tau + 1)[:, ::tau]


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln(A/B) of templates within r deviations, self-matches left out."""
    n, tol = len(x), r * x.std()
    if n < m + 2 or tol <= 0:
        return NAN
    a = b = 0
    e = _embedded(x, m + 1)
    for i in range(len(e) - 1):
        near = np.abs(e[i + 1 :, :m] - e[i, :m]).max(1) <= tol
        b += int(near.sum())
        a += int((near & (np.abs(e[i + 1 :, m] - e[i, m]) <= tol)).sum())
    return -math.log(a / b) if a and b else NAN


def permutation_entropy(x: np.ndarray, m: int = 3, tau: int = 1) -> float:
    """In nats; ties are ordered by place."""
    if len(x) < (m - 1) * tau + 1:
        return NAN
    orders = np.argsort(_embedded(x, m, tau), axis=1, kind="stable")
    _, counts = np.unique(orders @ (m ** np.arange(m)), return_counts=True)
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.polyfit(x, y, 1)[0]) if len(x) >= 2 else NAN


def hurst_rs(x: np.ndarray) -> float:
    n, sizes, values = len(x), [], []
    size = 8
    while size <= n // 2:
        parts = x[: n // size * size].reshape(-1, size)
        y = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
        s = parts.std(1)
        ok = s > 1e-15
        if ok.any():
            sizes.append(size)
            values.append(float(((y.max(1) - y.min(1))[ok] / s[ok]).mean()))
        size *= 2
    return _slope(np.log(sizes), np.log(values)) if len(sizes) >= 2 else NAN


def dfa(x: np.ndarray, low: int = 4, high: int | None = None) -> float:
    n = len(x)
    high = high or n // 4
    y = np.cumsum(x - x.mean())
    sizes = sorted({int(s) for s in np.geomspace(low, max(high, low), 12)})
    logs = []
    for s in sizes:
        if s < low or n // s < 2:
            continue
        parts = y[: n // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = parts @ t / (t @ t)
        rest = parts - parts.mean(1, keepdims=True) - slope[:, None] * t
        f = math.sqrt(float(np.square(rest).mean()))
        if f > 0:
            logs.append((math.log(s), math.log(f)))
    return _slope(*np.array(logs).T) if len(logs) >= 2 else NAN


def higuchi(x: np.ndarray, k_max: int = 10) -> float:
    n, logs = len(x), []
    for k in range(1, min(k_max, n // 2) + 1):
        lengths = []
        for m in range(k):
            part = x[m::k]
            if len(part) > 1:
                lengths.append(np.abs(np.diff(part)).sum() * (n - 1) / ((len(part) - 1) * k) / k)
        mean = float(np.mean(lengths)) if lengths else 0.0
        if mean > 0:
            logs.append((math.log(1 / k), math.log(mean)))
    return _slope(*np.array(logs).T) if len(logs) >= 2 else NAN


def lempel_ziv(x: np.ndarray) -> float:
    """Distinct phrases of the series cut at its median, times log2(n)/n."""
    n = len(x)
    if n < 2:
        return NAN
    bits = "".join("1" if v else "0" for v in x > np.median(x))
    at, phrases = 0, 0
    while at < n:
        size = 1
        while at + size <= n and bits[at : at + size] in bits[: at + size - 1]:
            size += 1
        phrases += 1
        at += size
    return phrases * math.log2(n) / n


# robust and nonparametric


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, where, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[where]


def mann_whitney(x: np.ndarray, y: np.ndarray) -> dict:
    n, m = len(x), len(y)
    both = np.concatenate([x, y])
    u1 = average_ranks(both)[:n].sum() - n * (n + 1) / 2
    _, t = np.unique(both, return_counts=True)
    total = n + m
    var = n * m / 12 * (total + 1 - (t**3 - t).sum() / (total * (total - 1)))
    u = min(u1, n * m - u1)
    z = (u - n * m / 2) / math.sqrt(var) if var > 0 else 0.0
    return {"statistic": float(u), "p": float(2 * sp.norm_cdf(-abs(z)))}


def wilcoxon(d: np.ndarray) -> dict:
    d = d[d != 0]
    n = len(d)
    if not n:
        return {"statistic": NAN, "p": NAN}
    r = average_ranks(np.abs(d))
    w = min(r[d > 0].sum(), r[d < 0].sum())
    _, t = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
    return {"statistic": float(w), "p": float(2 * sp.norm_cdf(-abs(w - n * (n + 1) / 4) / math.sqrt(var))) if var > 0 else NAN}


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b, from concordant less discordant pairs counted with a tree over ranks."""
    n = len(x)
    order = np.lexsort((y, x))
    a, b = x[order], y[order]
    ranks = np.unique(b, return_inverse=True)[1] + 1
    tree = np.zeros(ranks.max() + 1, np.int64)

    def seen(r: int) -> int:
        total = 0
        while r > 0:
            total += tree[r]
            r -= r & -r
        return total

    score = i = 0
    while i < n:
        j = i
        while j < n and a[j] == a[i]:
            score += seen(ranks[j] - 1) - (i - seen(ranks[j]))
            j += 1
        for r in ranks[i:j]:
            while r < len(tree):
                tree[r] += 1
                r += r & -r
        i = j
    pairs = n * (n - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    below = math.sqrt((pairs - ties[0]) * (pairs - ties[1]))
    return score / below if below > 0 else NAN


def ks_two(x: np.ndarray, y: np.ndarray) -> dict:
    grid = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(y), grid, "right") / len(y)).max())
    return {"statistic": d, "p": sp.kolmogorov_tail(d, len(x) * len(y) / (len(x) + len(y)))}


def wasserstein(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.sort(x), np.sort(y)
    if len(x) == len(y):
        return float(np.abs(x - y).mean())
    grid = np.sort(np.concatenate([x, y]))
    f, g = (np.searchsorted(v, grid[:-1], "right") / len(v) for v in (x, y))
    return float((np.abs(f - g) * np.diff(grid)).sum())


def m_estimate(x: np.ndarray, kind: str = "huber", k: float = 1.345) -> float:
    mid = float(np.median(x))
    scale = float(np.median(np.abs(x - mid))) * 1.4826
    if scale < 1e-15:
        return mid
    for _ in range(100):
        u = np.abs(x - mid) / scale
        w = np.where(u <= k, 1.0, k / np.maximum(u, 1e-300)) if kind == "huber" else np.where(u < k, (1 - (u / k) ** 2) ** 2, 0.0)
        if w.sum() <= 0:
            return mid
        new = float((w * x).sum() / w.sum())
        if abs(new - mid) < 1e-10 * scale:
            return new
        mid = new
    return mid


#: Values whose pairs are held at once; more are counted by sorting.
DIRECT = 2048


def merged(rank: np.ndarray):
    """The levels of a merge sort: places by block and rank, which of them lie in a block's second half, and blocks' first places."""
    n, at, width = len(rank), np.arange(len(rank)), 1
    while width < n:
        order = np.argsort(at // (2 * width) * n + rank)
        yield order, order // width % 2 == 1, at // (2 * width) * (2 * width)
        width *= 2


def before(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running totals from each block's first place on."""
    return total - np.where(first > 0, total[first - 1], 0)


def inversions(rank: np.ndarray) -> int:
    count = 0
    for _, second, first in merged(rank):
        count += int(before(np.cumsum(second), first)[~second].sum())
    return count


def slopes_up_to(x: np.ndarray, y: np.ndarray, t: float) -> int:
    """Pairs of different x whose slope is up to t: inversions of y - t x in the order of x."""
    r = y - t * x
    order = np.lexsort((r, x))
    x, r = x[order], r[order]
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((-np.arange(len(x)), r))] = np.arange(len(x))
    runs = np.diff(np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (r[1:] != r[:-1]), [True]])))
    return inversions(rank) - int((runs * (runs - 1) // 2).sum())


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median slope, by halving the range of slopes and counting those below, to the last digits of a slope."""
    n = len(x)
    runs = np.unique(x, return_counts=True)[1].astype(object)
    total = n * (n - 1) // 2 - int((runs * (runs - 1) // 2).sum())
    if not total:
        return NAN
    i, j = np.random.default_rng(0).integers(0, n, (2, 4096))
    i, j = i[x[i] != x[j]], j[x[i] != x[j]]
    guess = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    top = (y.max() - y.min()) / np.diff(np.unique(x)).min() * (1 + 1e-9) + 1e-300

    def nth(k: int) -> float:
        """The slope that k others are below (equal ones split), where at most k are up to lo and more than k up to hi."""
        lo, hi = -top, top
        for t in guess[[max(len(guess) // 2 - 150, 0), min(len(guess) // 2 + 150, len(guess) - 1)]] if len(guess) else ():
            lo, hi = (lo, min(hi, t)) if slopes_up_to(x, y, t) > k else (max(lo, t), hi)
        while hi - lo > 1e-14 * max(abs(lo), abs(hi)):
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            lo, hi = (lo, mid) if slopes_up_to(x, y, mid) > k else (mid, hi)
        return hi

    low = nth((total - 1) // 2)
    return low if total % 2 or slopes_up_to(x, y, low) > total // 2 else (low + nth(total // 2)) / 2


def theil_sen(x: np.ndarray, y: np.ndarray) -> dict:
    if len(x) <= DIRECT:
        i, j = np.triu_indices(len(x), 1)
        dx = x[j] - x[i]
        ok = dx != 0
        slope = float(np.median((y[j] - y[i])[ok] / dx[ok])) if ok.any() else NAN
    else:
        slope = float(median_slope(x, y))
    return {"slope": slope, "intercept": float(np.median(y) - slope * np.median(x))}


def skewness_z(n: float, g1: float) -> float:
    """D'Agostino's z of a population skewness."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    return math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(n: float, excess: float) -> float:
    """Anscombe and Glynn's z of a population excess kurtosis."""
    z = (excess + 3 - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    g = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / g * (2 / g + math.sqrt(1 + 4 / g**2))
    part = (1 - 2 / a) / (1 + z * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(part) ** (1 / 3), part)) / math.sqrt(2 / (9 * a))


def skewtest(x: np.ndarray) -> float:
    d = x - x.mean()
    s2 = float((d * d).mean())
    return skewness_z(len(x), float((d**3).mean()) / s2**1.5) if len(x) >= 8 and s2 > 0 else NAN


def kurtosistest(x: np.ndarray) -> float:
    d = x - x.mean()
    s2 = float((d * d).mean())
    return kurtosis_z(len(x), float((d**4).mean()) / s2**2 - 3) if len(x) >= 20 and s2 > 0 else NAN


def jarque_bera(x: np.ndarray) -> dict:
    n, d = len(x), x - x.mean()
    s2 = float((d * d).mean())
    if n < 3 or s2 <= 0:
        return {"statistic": NAN, "p": NAN}
    s, k = float((d**3).mean()) / s2**1.5, float((d**4).mean()) / s2**2 - 3
    jb = n / 6 * (s * s + k * k / 4)
    return {"statistic": jb, "p": 1 - sp.chi2_cdf(jb, 2)}


# volatility, change points, states


def garch(r: np.ndarray, rounds: int = 100) -> dict:
    """GARCH(1,1) by coordinate search on the Gaussian likelihood, with the variance targeted."""
    v = float(r.var())
    if len(r) < 10 or v <= 0:
        return {"omega": NAN, "alpha": NAN, "beta": NAN, "loglik": NAN}
    sq = r * r

    def loglik(a: float, b: float) -> float:
        if a < 0 or b < 0 or a + b >= 0.9999:
            return -math.inf
        h = v
        hs = np.array([v, *[h := c + b * h for c in (v * (1 - a - b) + a * sq[:-1]).tolist()]])
        return -float(np.cumsum(0.5 * (np.log(2 * math.pi * hs) + sq / hs))[-1])

    best, step = (0.1, 0.8), 0.1
    value = loglik(*best)
    for _ in range(rounds):
        tried = [(best[0] + i * step, best[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        found, top = max(((loglik(*p), -i, p) for i, p in enumerate(tried)))[::2]
        if found > value + 1e-12:
            best, value = top, found
        else:
            step /= 2
            if step < 1e-5:
                break
    return {"omega": v * (1 - sum(best)), "alpha": best[0], "beta": best[1], "loglik": value}


def cusum(x: np.ndarray) -> dict:
    """The largest excursion of the centred sum, scaled, and its place."""
    s = float(x.std())
    if len(x) < 2 or s <= 0:
        return {"statistic": 0.0, "place": -1}
    c = np.cumsum(x - x.mean())
    return {"statistic": float(np.abs(c).max() / (s * math.sqrt(len(x)))), "place": int(np.abs(c).argmax())}


def bocpd(x: np.ndarray, hazard: float = 0.01, threshold: float = 0.5, negligible: float = 1e-6) -> list[int]:
    """Places at which a new run is likelier than the threshold allows; normal data, unknown mean and variance.

    Runs of any length are tracked; one is left out only while its share of the mass is negligible.
    """
    half = np.arange(1, len(x) + 1) / 2 + 0.5  # a of each run length
    gammas = sp.log_gamma(half + 0.5) - sp.log_gamma(half)
    run, m, b = np.zeros(1, int), np.zeros(1), np.ones(1)
    mass, found, last = np.ones(1), [], 0
    for i, v in enumerate(x):
        k, a = run + 1.0, half[run]
        scale2 = b * (k + 1) / (a * k)
        logp = gammas[run] - 0.5 * np.log(2 * a * math.pi * scale2) - (a + 0.5) * np.log1p((v - m) ** 2 / (2 * a * scale2))
        p = np.exp(logp - logp.max()) * mass
        mass = np.append(p.sum() * hazard, p * (1 - hazard))
        mass /= mass.sum() or 1.0
        b = np.append(1.0, b + k * (v - m) ** 2 / (2 * (k + 1)))
        m = np.append(0.0, (k * m + v) / (k + 1))
        run = np.append(0, run + 1)
        if mass.min() < negligible:
            keep = mass >= negligible
            run, m, b, mass = run[keep], m[keep], b[keep], mass[keep]
            mass /= mass.sum()
        best = int(mass.argmax())
        start = i - int(run[best])
        if start > last and run[best] < i and mass[: best + 1].sum() > threshold:
            last = start
            found.append(last)
    return found


def viterbi(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        ls, lm, le = np.log(start), np.log(move), np.log(emit)
    score, back = ls + le[:, obs[0]], []
    for o in obs[1:]:
        step = score[:, None] + lm
        back.append(step.argmax(0))
        score = step.max(0) + le[:, o]
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return np.array(path[::-1])


def forward_backward(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, float]:
    """Posteriors of states and the log likelihood, scaled at each step."""
    n = len(obs)
    f, scale = np.empty((n, len(start))), np.empty(n)
    now = start * emit[:, obs[0]]
    for t in range(n):
        if t:
            now = (now @ move) * emit[:, obs[t]]
        scale[t] = now.sum() or 1.0
        now = f[t] = now / scale[t]
    b = np.ones(len(start))
    out = f.copy()
    for t in range(n - 2, -1, -1):
        b = move @ (emit[:, obs[t + 1]] * b) / scale[t + 1]
        out[t] = f[t] * b
    return out / out.sum(1, keepdims=True), float(np.log(scale).sum())


def rts(z: np.ndarray, f: float, h: float, q: float, r: float, x0: float = 0.0, p0: float = 1.0) -> np.ndarray:
    """Smoothed states of a scalar linear model."""
    xs, ps, xp, pp = [], [], [], []
    x, p = x0, p0
    for v in z:
        x, p = f * x, f * f * p + q
        xp.append(x)
        pp.append(p)
        k = p * h / (h * h * p + r)
        x, p = x + k * (v - h * x), (1 - k * h) * p
        xs.append(x)
        ps.append(p)
    out = xs[:]
    for t in range(len(z) - 2, -1, -1):
        out[t] = xs[t] + ps[t] * f / pp[t + 1] * (out[t + 1] - xp[t + 1])
    return np.array(out)


# interpolation, series, number theory


def interpolate(kind: str, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """lagrange, newton, linear, cubic (natural spline), akima or pchip (cubics by slopes at the knots)."""
    at = np.atleast_1d(np.asarray(at, float))
    if kind == "linear":
        return np.interp(at, x, y)
    if kind in ("lagrange", "newton"):
        c = y.astype(float).copy()
        for k in range(1, len(x)):
            c[k:] = (c[k:] - c[k - 1 : -1]) / (x[k:] - x[:-k])
        out = np.full(len(at), c[-1])
        for k in range(len(x) - 2, -1, -1):
            out = out * (at - x[k]) + c[k]
        return out
    if kind == "cubic":
        n, h = len(x), np.diff(x)
        m = np.zeros(n)
        if n > 2:
            a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
        a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
        return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6
    if kind in ("akima", "pchip"):
        h = np.diff(x)
        m = np.diff(y) / h
        slope = _akima_slopes(m) if kind == "akima" else _monotone_slopes(h, m)
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
        t = (at - x[i]) / h[i]
        return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * t * (3 - 2 * t) * y[i + 1] + h[i] * (t * (1 - t) ** 2 * slope[i] - t * t * (1 - t) * slope[i + 1])
    raise ValueError(kind)


def _akima_slopes(m: np.ndarray) -> np.ndarray:
    """Means of neighbouring secants, each weighted by the change on the other side; two secants are added at both ends."""
    if len(m) == 1:
        return np.repeat(m, 2)
    e = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    left, right = np.abs(e[1:-2] - e[:-3]), np.abs(e[3:] - e[2:-1])
    total = left + right
    flat = total < 1e-12
    return np.where(flat, (e[1:-2] + e[2:-1]) / 2, (right * e[1:-2] + left * e[2:-1]) / np.where(flat, 1.0, total))


def _monotone_slopes(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Weighted harmonic means of neighbouring secants of one sign, else 0; ends by a three-point rule that keeps the shape."""
    if len(m) == 1:
        return np.repeat(m, 2)
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = m[1:] * m[:-1] > 0
    inner = np.where(same, (a + b) / (a / np.where(same, m[:-1], 1.0) + b / np.where(same, m[1:], 1.0)), 0.0)

    def end(h0: float, h1: float, m0: float, m1: float) -> float:
        d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return 0.0 if d * m0 <= 0 else 3 * m0 if m0 * m1 <= 0 and abs(d) > 3 * abs(m0) else d

    return np.concatenate([[end(h[0], h[1], m[0], m[1])], inner, [end(h[-1], h[-2], m[-1], m[-2])]])


def aitken(s: np.ndarray) -> np.ndarray:
    d, d2 = np.diff(s), np.diff(s, 2)
    return np.where(np.abs(d2) > 1e-300, s[:-2] - d[:-1] ** 2 / np.where(d2 == 0, 1, d2), s[2:])


def wynn(s: np.ndarray) -> float:
    """The last even column of the epsilon table of partial sums."""
    before, now = np.zeros(len(s) + 1), s.astype(float)
    best = now[-1]
    for k in range(1, len(s)):
        d = np.diff(now)
        if (np.abs(d) < 1e-300).any():
            break
        before, now = now, before[1:-1] + 1 / d
        if k % 2 == 0:
            best = now[-1]
    return float(best)


def totient(n: int) -> int:
    out = n
    for p in {p for p, _ in factorize(n)}:
        out -= out // p
    return out


def factorize(n: int) -> list[tuple[int, int]]:
    out, p = [], 2
    while p * p <= n:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        if k:
            out.append((p, k))
        p += 1 + (p > 2)
    return out + [(n, 1)] if n > 1 else out


def is_prime(n: int) -> bool:
    return n > 1 and factorize(n) == [(n, 1)]
