"""Kernels on matrices of rows and columns: factors, group tests, embeddings, clusters, survival, item responses."""

from __future__ import annotations

import math

import numpy as np

from tessera.functions import special as sp

NAN = math.nan


def correlation(a: np.ndarray) -> np.ndarray:
    c = np.cov(a, rowvar=False).reshape(a.shape[1], a.shape[1])
    d = np.maximum(np.sqrt(np.diag(c)), 1e-15)
    return c / np.outer(d, d)


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


# factors


def principal_axes(corr: np.ndarray, factors: int = 2, rounds: int = 100, tol: float = 1e-6) -> dict:
    """Loadings by eigenvectors of the correlations with communalities on the diagonal, until these settle."""
    p = len(corr)
    inverse = np.linalg.pinv(corr)
    h = np.clip(1 - 1 / np.maximum(np.diag(inverse), 1e-12), 0.0, 1.0)
    for _ in range(rounds):
        reduced = corr.copy()
        reduced[np.arange(p), np.arange(p)] = h
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(values)[::-1][:factors]
        loadings = signed(vectors[:, top]) * np.sqrt(np.maximum(values[top], 0.0))
        new = np.minimum((loadings**2).sum(1), 1.0)
        settled, h = np.abs(new - h).max() < tol, new
        if settled:
            break
    return {"loadings": loadings, "communalities": h, "uniquenesses": 1 - h}


def omega(loadings: np.ndarray) -> float:
    """Of the first factor; mixed signs count by size."""
    first = loadings[:, 0]
    total = float((np.abs(first) if (first > 0).any() and (first < 0).any() else first).sum()) ** 2
    unique = float((1 - first**2).sum())
    return total / (total + unique) if total + unique > 0 else NAN


def varimax(loadings: np.ndarray, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    p, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        a = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (a**3 - a @ np.diag((a * a).sum(0)) / p))
        turn = u @ v
        if s.sum() <= before * (1 + tol):
            break
        before = s.sum()
    return loadings @ turn


# groups


def hotelling_two(a: np.ndarray, b: np.ndarray) -> dict:
    n, m, p = len(a), len(b), a.shape[1]
    pooled = ((n - 1) * np.cov(a, rowvar=False) + (m - 1) * np.cov(b, rowvar=False)).reshape(p, p) / (n + m - 2)
    d = a.mean(0) - b.mean(0)
    t2 = n * m / (n + m) * float(d @ np.linalg.solve(pooled, d))
    f, df2 = t2 * (n + m - p - 1) / (p * (n + m - 2)), n + m - p - 1
    return {"t2": t2, "f": f, "df1": p, "df2": df2, "p": float(1 - sp.f_cdf(f, p, df2))}


def scatter(a: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scatter within and between groups, and their number."""
    names, g = np.unique(groups, return_inverse=True)
    means = np.stack([a[g == k].mean(0) for k in range(len(names))])
    d, e = a - means[g], means[g] - a.mean(0)
    return d.T @ d, e.T @ e, len(names)


def manova(a: np.ndarray, groups: np.ndarray) -> dict:
    """Wilks' lambda with Rao's F."""
    w, b, k = scatter(a, groups)
    n, p, q = len(a), a.shape[1], k - 1
    lam = math.exp(np.linalg.slogdet(w)[1] - np.linalg.slogdet(w + b)[1])
    s = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    m = n - 1 - (p + k) / 2
    df1, df2 = p * q, m * s - p * q / 2 + 1
    root = lam ** (1 / s)
    f = (1 - root) / root * df2 / df1
    return {"wilks": lam, "f": f, "df1": df1, "df2": df2, "p": float(1 - sp.f_cdf(f, df1, df2))}


def discriminants(a: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Axes of largest spread between groups against within, of unit length."""
    w, b, k = scatter(a, groups)
    values, vectors = np.linalg.eigh(w + 1e-10 * np.trace(w) / len(w) * np.eye(len(w)))
    half = vectors / np.sqrt(values) @ vectors.T
    ev, axes = np.linalg.eigh(half @ b @ half)
    top = np.argsort(ev)[::-1][: min(k - 1, a.shape[1])]
    axes = half @ axes[:, top]
    return signed(axes / np.linalg.norm(axes, axis=0))


def canonical_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = (np.linalg.qr(v - v.mean(0))[0] for v in (x, y))
    return np.clip(np.linalg.svd(a.T @ b, compute_uv=False), 0.0, 1.0)


def mardia(a: np.ndarray) -> dict:
    n, p = a.shape
    d = a - a.mean(0)
    g = d @ np.linalg.solve(np.cov(a, rowvar=False).reshape(p, p), d.T)
    skew, kurt = float((g**3).mean()), float((np.diag(g) ** 2).mean())
    df = p * (p + 1) * (p + 2) / 6
    z = (kurt - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n)
    return {"skewness": skew, "skewness_p": float(1 - sp.chi2_cdf(n * skew / 6, df)), "kurtosis": kurt, "kurtosis_p": float(2 * sp.norm_cdf(-abs(z)))}


# clusters and embeddings


def squared_distances(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    b = a if b is None else b
    return ((a[:, None] - b[None]) ** 2).sum(2)


def farthest_first(a: np.ndarray, k: int) -> np.ndarray:
    """Rows that start k clusters: the nearest to the mean, then always the farthest from those chosen."""
    chosen = [int(((a - a.mean(0)) ** 2).sum(1).argmin())]
    d = ((a - a[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(a)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((a - a[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def k_means(a: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    centres, labels = a[farthest_first(a, k)], None
    for _ in range(rounds):
        new = ((a**2).sum(1)[:, None] - 2 * a @ centres.T + (centres**2).sum(1)).argmin(1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for j in range(len(centres)):
            if (labels == j).any():
                centres[j] = a[labels == j].mean(0)
    return labels


def silhouette(a: np.ndarray, labels: np.ndarray) -> float:
    names, g = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return NAN
    d, n = np.sqrt(squared_distances(a)), np.bincount(g)
    sums = np.stack([d[:, g == k].sum(1) for k in range(len(names))], 1)
    own = sums[np.arange(len(a)), g] / np.maximum(n[g] - 1, 1)
    other = sums / n
    other[np.arange(len(a)), g] = math.inf
    b = other.min(1)
    return float(np.where(n[g] > 1, (b - own) / np.maximum(np.maximum(own, b), 1e-300), 0.0).mean())


def hopkins(a: np.ndarray, m: int = 10, seed: int = 42) -> float:
    """Near 1 for clusters, 0.5 for none: distances of random places against those of rows."""
    r = np.random.default_rng(seed)
    m = min(m, len(a))
    rows = r.choice(len(a), m, replace=False)
    places = a.min(0) + r.random((m, a.shape[1])) * (a.max(0) - a.min(0))
    d = squared_distances(a[rows], a)
    d[np.arange(m), rows] = math.inf
    u, w = np.sqrt(squared_distances(places, a).min(1)).sum(), np.sqrt(d.min(1)).sum()
    return float(u / (u + w)) if u + w > 0 else 0.5


def cluster_auto(a: np.ndarray, most: int = 8, rounds: int = 300) -> dict:
    """The number of clusters of the best silhouette."""
    best = (-math.inf, 2)
    for k in range(2, max(2, min(most, len(a) // 2)) + 1):
        s = silhouette(a, k_means(a, k, rounds))
        if s > best[0]:
            best = (s, k)
    return {"silhouette": best[0], "k": best[1], "hopkins": hopkins(a)}


def spectral_embedding(a: np.ndarray, k: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Eigenvectors of the least eigenvalues of the normalised Laplacian of Gaussian affinities, the first left out."""
    w = np.exp(-squared_distances(a) / (2 * sigma * sigma))
    np.fill_diagonal(w, 0.0)
    d = 1 / np.sqrt(np.maximum(w.sum(1), 1e-300))
    _, v = np.linalg.eigh(np.eye(len(a)) - d[:, None] * w * d)
    return signed(v[:, 1 : k + 1])


def spectral_clusters(a: np.ndarray, k: int, sigma: float = 1.0, rounds: int = 100) -> np.ndarray:
    w = np.exp(-squared_distances(a) / (2 * sigma * sigma))
    np.fill_diagonal(w, 0.0)
    d = 1 / np.sqrt(np.maximum(w.sum(1), 1e-300))
    v = np.linalg.eigh(np.eye(len(a)) - d[:, None] * w * d)[1][:, :k]
    return k_means(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), k, rounds)


def nmf(a: np.ndarray, k: int, rounds: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative updates of non-negative factors."""
    r = np.random.default_rng(seed)
    a = np.maximum(a, 0.0)
    w, h = r.random((a.shape[0], k)) + 0.1, r.random((k, a.shape[1])) + 0.1
    for _ in range(rounds):
        h *= (w.T @ a) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (a @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


def tsne(a: np.ndarray, perplexity: float = 30.0, rounds: int = 1000, rate: float = 200.0, seed: int = 42) -> np.ndarray:
    """Two dimensions whose neighbours are the rows' neighbours."""
    n, d = len(a), squared_distances(a)
    p, want = np.zeros((n, n)), math.log(min(perplexity, max(2.0, (n - 1) / 3)))
    for i in range(n):
        lo, hi, beta, row = 0.0, math.inf, 1.0, np.delete(d[i], i)
        for _ in range(60):
            e = np.exp(-(row - row.min()) * beta)
            q = e / e.sum()
            gap = float(-(q * np.log(np.maximum(q, 1e-300))).sum()) - want
            if abs(gap) < 1e-6:
                break
            lo, hi = (beta, hi) if gap > 0 else (lo, beta)
            beta = beta * 2 if hi == math.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    step = np.zeros_like(y)
    for t in range(rounds):
        w = 1 / (1 + squared_distances(y))
        np.fill_diagonal(w, 0.0)
        q = np.maximum(w / w.sum(), 1e-12)
        g = ((p * (4 if t < 100 else 1) - q) * w)[:, :, None] * (y[:, None] - y[None])
        step = (0.5 if t < 250 else 0.8) * step - rate * 4 * g.sum(1)
        y = y + step
        y -= y.mean(0)
    return y


# regressions


def two_predictors(x: np.ndarray, m: np.ndarray, y: np.ndarray) -> dict:
    design = np.column_stack([np.ones(len(x)), x, m])
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    total = float(((y - y.mean()) ** 2).sum())
    return {"intercept": float(b[0]), "slope_x": float(b[1]), "slope_m": float(b[2]), "r2": 1 - float(((y - design @ b) ** 2).sum()) / total if total > 0 else NAN}


def bayes_linear(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, precision: float = 0.01) -> dict:
    """The conjugate posterior of coefficients around zero, without an intercept."""
    prior = precision * np.eye(x.shape[1])
    post = prior + x.T @ x
    mean = np.linalg.solve(post, x.T @ y)
    a, b = alpha + len(y) / 2, beta + 0.5 * float(y @ y - mean @ post @ mean)
    return {"mean": mean, "sigma2": b / (a - 1) if a > 1 else NAN, "alpha": a, "beta": b}


def cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, rounds: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Coefficients of proportional hazards by Newton's steps on Breslow's partial likelihood."""
    order = np.argsort(-time, kind="stable")
    x, time, event = x[order], time[order], event[order].astype(bool)
    last = np.searchsorted(-time, -time, "right") - 1  # all at risk: those of the same time or later
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = np.exp(np.clip(x @ beta, -500, 500))
        s0, s1 = np.cumsum(w)[last], np.cumsum(w[:, None] * x, 0)[last]
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None], 0)[last]
        m = s1 / s0[:, None]
        grad = (x - m)[event].sum(0)
        info = (s2 / s0[:, None, None] - m[:, :, None] * m[:, None])[event].sum(0)
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            break
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta


def gmres(a: np.ndarray, b: np.ndarray, tol: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Least residual over growing Krylov spaces, restarted when they are full."""
    x, n = np.zeros(len(b)), len(b)
    for _ in range(max(1, rounds // n)):
        r = b - a @ x
        size = float(np.linalg.norm(r))
        if size <= tol * max(float(np.linalg.norm(b)), 1e-300):
            break
        q, h = np.zeros((n + 1, n)), np.zeros((n + 1, n))
        q[0], k = r / size, 0
        for k in range(n):
            v = a @ q[k]
            for _twice in range(2):
                c = q[: k + 1] @ v
                h[: k + 1, k] += c
                v = v - c @ q[: k + 1]
            h[k + 1, k] = np.linalg.norm(v)
            if h[k + 1, k] < 1e-14:
                break
            q[k + 1] = v / h[k + 1, k]
        first = np.zeros(k + 2)
        first[0] = size
        y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], first, rcond=None)
        x = x + y @ q[: k + 1]
    return x


# item responses


def fit_2pl(u: np.ndarray, rounds: int = 100, nodes: int = 21) -> np.ndarray:
    """(discrimination, difficulty) of items by expectation over a normal ability and Newton's steps."""
    at = np.linspace(-4, 4, nodes)
    prior = np.exp(-0.5 * at * at)
    prior /= prior.sum()
    p = np.clip(u.mean(0), 0.01, 0.99)
    a, b = np.ones(u.shape[1]), -np.log(p / (1 - p))
    for _ in range(rounds):
        pr = np.clip(1 / (1 + np.exp(-a * (at[:, None] - b))), 1e-9, 1 - 1e-9)
        like = u @ np.log(pr).T + (1 - u) @ np.log(1 - pr).T
        post = np.exp(like - like.max(1, keepdims=True)) * prior
        post /= post.sum(1, keepdims=True)
        n, right = post.sum(0), post.T @ u
        old = np.concatenate([a, b])
        for j in range(u.shape[1]):
            c, s = -a[j] * b[j], a[j]  # logit = c + s * ability
            for _step in range(5):
                q = 1 / (1 + np.exp(-(c + s * at)))
                e, w = right[:, j] - n * q, n * q * (1 - q) + 1e-12
                info = np.array([[w.sum(), w @ at], [w @ at, w @ (at * at)]]) + 1e-6 * np.eye(2)
                dc, ds = np.linalg.solve(info, [e.sum(), e @ at])
                c, s = c + dc, min(max(s + ds, 0.05), 5.0)
            a[j], b[j] = s, -c / s
        if np.abs(np.concatenate([a, b]) - old).max() < 1e-6:
            break
    return np.stack([a, b], 1)


def ability_ml(u: np.ndarray, a: np.ndarray, b: np.ndarray, bound: float = 4.0) -> float:
    """The ability of largest likelihood, within bounds that all right or all wrong answers reach."""
    if u.all():
        return bound
    if not u.any():
        return -bound
    lo, hi = -bound, bound
    slope = lambda t: float((a * (u - 1 / (1 + np.exp(-a * (t - b))))).sum())
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def ability_mean(u: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: int = 21) -> float:
    """The posterior mean under a normal prior on a grid."""
    at = np.linspace(-4, 4, nodes)
    p = 1 / (1 + np.exp(-a * (at[:, None] - b)))
    w = np.exp(-0.5 * at * at) * np.prod(np.where(u > 0, p, 1 - p), 1)
    return float((w @ at) / w.sum())
