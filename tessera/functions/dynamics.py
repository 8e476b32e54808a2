"""Kernels on ordered series: filters, recurrence, scaling, coupling, processes, sums of series."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import kernels as kn

NAN = math.nan


def moving_average(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Centred; shorter at both ends."""
    half, total = window // 2, np.append(0.0, np.cumsum(x))
    i = np.arange(len(x))
    lo, hi = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (total[hi] - total[lo]) / (hi - lo)


def median_filter(x: np.ndarray, window: int = 5) -> np.ndarray:
    half = window // 2
    return np.array([np.median(x[max(0, i - half) : i + half + 1]) for i in range(len(x))])


def ema(x: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    return kn.ses(x, alpha)


def holt(x: np.ndarray, alpha: float = 0.3, beta: float = 0.1, horizon: int = 10) -> np.ndarray:
    """Forecasts of level and trend; the first two values start them."""
    if len(x) < 2:
        return np.full(horizon, NAN)
    level, trend = x[0], x[1] - x[0]
    for v in x[1:]:
        before, level = level, alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
    return level + trend * np.arange(1, horizon + 1)


def ewma_variance(x: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """From the first squared value on."""
    out, v = np.empty(len(x)), float(np.mean(x * x)) if len(x) else NAN
    for i, r in enumerate(x):
        out[i] = v
        v = decay * v + (1 - decay) * r * r
    return out


def zero_crossing_rate(x: np.ndarray) -> float:
    return float(((x[1:] >= 0) != (x[:-1] >= 0)).mean()) if len(x) > 1 else 0.0


def effective_size(x: np.ndarray) -> float:
    """Sample size over the autocorrelation time; pair sums are summed while positive, and never rise."""
    n = len(x)
    d = x - x.mean()
    var = float(d @ d) / n
    if n < 10 or var < 1e-15:
        return float(n)
    rho = [float(d[: n - k] @ d[k:]) / (n * var) for k in range(1, n // 2 + 1)]
    total, least = 0.0, math.inf
    for k in range(0, len(rho) - 1, 2):
        least = min(least, rho[k] + rho[k + 1])
        if least <= 0:
            break
        total += least
    return min(float(n), n / (1 + 2 * total))


def recurrence(x: np.ndarray, m: int = 2, tau: int = 1, epsilon: float = 0.1, least: int = 2) -> dict:
    """Rates, lines and their entropy in the plot of near states."""
    n = len(x) - (m - 1) * tau
    names = ("rate", "determinism", "laminarity", "entropy", "longest", "mean_line", "trapping")
    if n < 2 or epsilon <= 0:
        return dict.fromkeys(names, NAN)
    e = np.stack([x[k * tau : k * tau + n] for k in range(m)], 1)
    near = ((e[:, None] - e[None]) ** 2).sum(2) <= epsilon * epsilon
    np.fill_diagonal(near, False)

    def runs(row: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        return edge[1::2] - edge[::2]

    diagonal = np.concatenate([runs(np.diagonal(near, k)) for k in range(1, n)] or [np.empty(0, int)])
    vertical = np.concatenate([runs(near[:, j]) for j in range(n)])
    total = int(near.sum())
    d, v = diagonal[diagonal >= least], vertical[vertical >= least]
    p = np.bincount(d)[1:] / len(d) if len(d) else np.empty(0)
    p = p[p > 0]
    return {
        "rate": total / (n * (n - 1)), "determinism": 2 * d.sum() / total if total else 0.0, "laminarity": v.sum() / total if total else 0.0,
        "entropy": float(-(p * np.log(p)).sum()), "longest": int(d.max(initial=0)), "mean_line": float(d.mean()) if len(d) else 0.0, "trapping": float(v.mean()) if len(v) else 0.0,
    }


def multifractal(x: np.ndarray, low: int = 16, high: int | None = None, qs: tuple[float, ...] = (-3.0, -2.0, -1.0, 0.5, 1.0, 1.5, 2.0, 3.0)) -> dict:
    """Slopes of the q-order fluctuations of the detrended profile over scales: their range, that of q = 2, their mean error."""
    n = len(x)
    high = max(low, n // 4) if high is None else high
    scales = np.unique(np.geomspace(low, high, 12).astype(int)) if high > low else np.array([low])
    profile = np.cumsum(x - x.mean())
    f = []
    for s in scales:
        parts = [profile[: n // s * s].reshape(-1, s), profile[n - n // s * s :].reshape(-1, s)]
        t = np.arange(s) - (s - 1) / 2
        var = []
        for p in parts:
            d = p - p.mean(1, keepdims=True)
            d = d - (d @ t)[:, None] * t / float(t @ t)
            var.append((d * d).mean(1))
        v = np.maximum(np.concatenate(var), 1e-300)
        f.append([float(np.mean(v ** (q / 2)) ** (1 / q)) for q in qs])
    logs, ls = np.log(np.array(f)), np.log(scales)
    if len(scales) < 3:
        return {"width": NAN, "h2": NAN, "error": NAN}
    c = ls - ls.mean()
    h = c @ logs / float(c @ c)
    e = logs - logs.mean(0) - c[:, None] * h
    return {"width": float(h.max() - h.min()), "h2": float(h[qs.index(2.0)]), "error": float(np.sqrt((e * e).sum(0) / (len(ls) - 2) / float(c @ c)).mean())}


def cross_mapping(x: np.ndarray, y: np.ndarray, dim: int = 3, tau: int = 1, k: int | None = None) -> dict:
    """How well each series is told from neighbours in the other's delay space, for all and for half of the points."""
    k = dim + 1 if k is None else k
    start, n = (dim - 1) * tau, min(len(x), len(y))
    space = lambda v: np.stack([v[start - d * tau : n - d * tau] for d in range(dim)], 1)

    def skill(of: np.ndarray, through: np.ndarray, count: int) -> float:
        e, target = space(through)[:count], of[start:n][:count]
        if count < k + 2:
            return NAN
        d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
        np.fill_diagonal(d, math.inf)
        near = np.argsort(d, 1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
        told = (w * target[near]).sum(1) / w.sum(1)
        return float(np.corrcoef(told, target)[0, 1])

    m = n - start
    xy, yx, hx, hy = skill(y, x, m), skill(x, y, m), skill(y, x, m // 2), skill(x, y, m // 2)
    return {"rho_xy": xy, "rho_yx": yx, "rho_xy_half": hx, "rho_yx_half": hy, "convergence": yx - hy}


def phase_transition(x: np.ndarray, window: int | None = None) -> dict:
    """Of signs as spins: mean size, spread and fourth-order cumulant of their rolling means."""
    n = len(x)
    w = max(1, n // 10) if window is None else window
    if n < 2 * w:
        return {"order": NAN, "susceptibility": NAN, "binder": NAN}
    c = np.append(0.0, np.cumsum(np.sign(x)))
    m = (c[w:] - c[:-w]) / w
    m2 = float((m**2).mean())
    return {"order": float(np.abs(m).mean()), "susceptibility": float(m.var() * len(m)), "binder": 1 - float((m**4).mean()) / (3 * m2 * m2) if m2 > 1e-30 else NAN}


def spacing_ratio(levels: np.ndarray) -> float:
    """Mean ratio of the smaller to the larger of neighbouring gaps."""
    total, n = spacing_sums(np.sort(levels))
    return total / n if n else NAN


def spacing_sums(levels: np.ndarray) -> tuple[float, int]:
    """The sum of those ratios over sorted levels, and their number."""
    g = np.diff(levels)
    hi, lo = np.maximum(g[1:], g[:-1]), np.minimum(g[1:], g[:-1])
    live = hi >= 1e-30
    return float((lo[live] / hi[live]).sum()), int(live.sum())


def hankel_ratio(x: np.ndarray, dim: int = 3) -> float:
    """The spacing ratio of the singular values of delayed copies."""
    if len(x) < dim + 3:
        return NAN
    return spacing_ratio(np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, dim), compute_uv=False))


def arch_lm(x: np.ndarray, lags: int) -> float:
    """The p value of squared values regressed on their lags."""
    from tessera.functions import special as sp

    e = (x - x.mean()) ** 2
    if len(e) < 2 * lags + 2:
        return 1.0
    design = np.column_stack([np.ones(len(e) - lags), *[e[lags - k : len(e) - k] for k in range(1, lags + 1)]])
    y = e[lags:]
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    total = float(((y - y.mean()) ** 2).sum())
    r2 = 1 - float(((y - design @ b) ** 2).sum()) / total if total > 0 else 0.0
    return float(1 - sp.chi2_cdf(len(y) * r2, lags))


def series_advice(x: np.ndarray, lags: int = 5) -> dict:
    """Stationarity by two opposite tests, and the family of models that correlations and their squares call for."""
    stat = kn.adf(x, lags)
    unit, level = stat < -2.86, kn.kpss(x) > 0.463
    state = "stationary" if unit and not level else "non-stationary" if level and not unit else "trend-stationary" if unit else "inconclusive"
    significant = int((np.abs(kn.acf(x, max(1, min(20, len(x) // 4)))[1:]) > 2 / math.sqrt(len(x))).sum())
    arch = arch_lm(x, max(1, min(5, len(x) // 10))) < 0.05
    if level and not unit:
        model = "difference + ARIMA-GARCH" if arch else "difference + ARIMA"
    else:
        model = "AR + GARCH" if arch else "AR/ARMA model" if significant else "white noise"
    return {"adf": stat, "kpss": kn.kpss(x), "state": state, "model": model, "significant_lags": significant, "arch": arch}


# state space


def particle_filter(z: np.ndarray, process: float = 1.0, noise: float = 1.0, n: int = 500, seed: int = 42) -> np.ndarray:
    """Filtered means of a random walk seen with noise; systematic resampling at each step, missing values pass."""
    r = np.random.default_rng(seed)
    p, out = r.normal(0, 1, n), np.empty(len(z))
    for t, v in enumerate(z):
        p = p + r.normal(0, math.sqrt(process), n)
        w = np.full(n, 1 / n)
        if v == v:
            lw = -0.5 * (v - p) ** 2 / noise
            w = np.exp(lw - lw.max())
            w /= w.sum()
        out[t] = w @ p
        p = p[np.minimum(np.searchsorted(np.cumsum(w), (r.random() + np.arange(n)) / n), n - 1)]
    return out


def uniform_model(states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((states, symbols), 1 / symbols)


def log_likelihood(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
    a, total = start, 0.0
    for t, o in enumerate(obs.astype(int)):
        a = (a if t == 0 else a @ move) * emit[:, o]
        s = a.sum()
        total, a = total + math.log(s), a / s
    return total


# processes


def ornstein_uhlenbeck(x0: float = 0.0, mu: float = 0.0, theta: float = 1.0, sigma: float = 0.5, t: float = 1.0, steps: int = 1000, seed: int = 42) -> np.ndarray:
    """Exact steps of the mean-reverting process."""
    dt, r = t / steps, np.random.default_rng(seed)
    keep = math.exp(-theta * dt)
    sd = sigma * math.sqrt((1 - keep * keep) / (2 * theta)) if theta else sigma * math.sqrt(dt)
    out = np.empty(steps + 1)
    out[0] = x0
    for i, z in enumerate(r.standard_normal(steps)):
        out[i + 1] = mu + (out[i] - mu) * keep + sd * z
    return out


def walk(t: float = 1.0, steps: int = 1000, seed: int = 42, drift: float = 0.0, sigma: float = 1.0, s0: float | None = None) -> np.ndarray:
    """A Brownian path from 0, or a geometric one from s0."""
    dt, z = t / steps, np.random.default_rng(seed).standard_normal(steps)
    path = np.append(0.0, np.cumsum((drift - (sigma * sigma / 2 if s0 is not None else 0.0)) * dt + sigma * math.sqrt(dt) * z))
    return path if s0 is None else s0 * np.exp(path)


def poisson_events(rate: float = 1.0, t: float = 10.0, seed: int = 42) -> np.ndarray:
    r, at, out = np.random.default_rng(seed), 0.0, []
    while rate > 0 and (at := at + r.exponential(1 / rate)) <= t:
        out.append(at)
    return np.array(out)


def oscillator(x0: float = 1.0, v0: float = 0.0, omega: float = 1.0, t: float = 0.0) -> tuple[float, float]:
    """Place and speed of a harmonic oscillator."""
    c, s = math.cos(omega * t), math.sin(omega * t)
    return x0 * c + (v0 / omega * s if omega else v0 * t), v0 * c - x0 * omega * s


# sums of series


def cesaro(terms: np.ndarray) -> float:
    return float(np.cumsum(terms).mean()) if len(terms) else 0.0


def euler(terms: np.ndarray) -> float:
    """Binomial means of the partial sums, by halving neighbours again and again."""
    s = np.cumsum(terms)
    while len(s) > 1:
        s = (s[1:] + s[:-1]) / 2
    return float(s[0]) if len(s) else 0.0


def accelerated(terms: np.ndarray) -> float:
    """Aitken's for ratios that settle, the nearer of Euler's and Wynn's to it for alternating signs, else Wynn's."""
    if len(terms) < 3:
        return float(np.sum(terms))
    first, sums = terms[:10], np.cumsum(terms)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = first[1:] / first[:-1]
    aitken = kn.aitken(sums)
    last = float(aitken[-1]) if len(aitken) else float(sums[-1])
    if np.isfinite(ratio).all() and (ratio < 0).all():
        return min((euler(terms), float(kn.wynn(sums))), key=lambda v: abs(v - last))
    if np.isfinite(ratio).all() and ratio.std() < 0.05 and abs(ratio.mean()) < 1:
        return last
    return float(kn.wynn(sums))
