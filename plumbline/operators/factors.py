"""Unsupervised models on bounded matrices: factors, mixtures, linkage, and agreement of labelings.

The cluster sums moments (operators.models); what runs here is on the driver, over a matrix of the columns or a
sample whose size is a parameter.
"""

from __future__ import annotations

import math

import numpy as np

#: Rows up to which linkage, silhouettes and bootstraps take a sample.
MOST_ROWS = 3_000


def correlation_from(cov):
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    return cov / np.outer(sd, sd)


def varimax(loadings, rounds: int = 200, tol: float = 1e-10):
    """Rotation that maximises the variance of squared loadings; returns the rotated loadings and the rotation."""
    n, k = loadings.shape
    r, last = np.eye(k), 0.0
    for _ in range(rounds):
        x = loadings @ r
        u, s, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).sum(axis=0) / n))
        r = u @ v
        if s.sum() - last < tol * max(1.0, s.sum()):
            break
        last = s.sum()
    return loadings @ r, r


def principal_axis(corr, factors: int, rounds: int = 200, tol: float = 1e-8):
    """Principal-axis factoring with iterated communalities."""
    h = 1 - 1 / np.maximum(np.diag(np.linalg.pinv(corr)), 1.0)
    for _ in range(rounds):
        m = corr.copy()
        np.fill_diagonal(m, h)
        w, v = np.linalg.eigh(m)
        top = np.argsort(-w)[:factors]
        load = v[:, top] * np.sqrt(np.maximum(w[top], 0))
        new = np.minimum((load**2).sum(axis=1), 1.0)
        if np.abs(new - h).max() < tol:
            break
        h = new
    load *= np.sign(load[np.abs(load).argmax(axis=0), np.arange(factors)])
    return load, h


def parallel_analysis(x, rounds: int = 50, level: float = 0.95, seed: int = 130013):
    """(eigenvalues, thresholds, how many are above): thresholds from column-wise permutations."""
    rng = np.random.default_rng(seed)
    own = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    null = np.array([np.sort(np.linalg.eigvalsh(np.corrcoef(np.array([rng.permutation(c) for c in x.T]))))[::-1] for _ in range(rounds)])
    cut = np.quantile(null, level, axis=0)
    above = own > cut
    return own, cut, int(np.argmin(above)) if not above.all() else len(own)


def nearest_psd(corr, floor: float = 1e-8):
    """The correlation matrix with its eigenvalues clipped, scaled back to a unit diagonal."""
    w, v = np.linalg.eigh((corr + corr.T) / 2)
    return correlation_from((v * np.maximum(w, floor)) @ v.T)


def diagonal_gmm(x, k: int, rounds: int = 200, seed: int = 0, floor: float = 1e-6):
    """EM of a diagonal mixture: weights, means, variances, log likelihood, AIC, BIC."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    mean = x[rng.choice(n, k, replace=False)].copy()
    var, w, last = np.tile(x.var(axis=0) + floor, (k, 1)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        logp = np.log(w) - 0.5 * (np.log(2 * math.pi * var).sum(axis=1) + (((x[:, None] - mean) ** 2) / var).sum(axis=2))
        top = logp.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        r = np.exp(logp - total[:, None])
        ll = total.sum()
        nk = r.sum(axis=0) + 1e-12
        w, mean = nk / n, (r.T @ x) / nk[:, None]
        var = np.maximum((r.T @ x**2) / nk[:, None] - mean**2, floor)
        if ll - last < 1e-9 * abs(ll):
            break
        last = ll
    free = k * 2 * d + k - 1
    return {"weights": w, "means": mean, "variances": var, "loglik": float(ll), "aic": float(2 * free - 2 * ll), "bic": float(free * math.log(n) - 2 * ll)}


def average_linkage(x, k: int):
    """Labels of k clusters by average linkage on at most MOST_ROWS rows, numbered by first member."""
    if len(x) > MOST_ROWS:
        raise ValueError(f"average linkage takes a sample of at most {MOST_ROWS} rows")
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    size, alive, of = np.ones(len(x)), np.ones(len(x), bool), np.arange(len(x))
    for _ in range(len(x) - k):
        i, j = divmod(int(np.argmin(d)), len(x))
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        d[i, i], alive[j] = np.inf, False
        size[i] += size[j]
        of[of == j] = i
    return np.unique(of, return_inverse=True)[1]


def cluster_metrics(x, labels):
    """Silhouette, Calinski-Harabasz and Davies-Bouldin (with the largest radius of each cluster) of a sample."""
    ids = np.unique(labels)
    centre = np.array([x[labels == c].mean(axis=0) for c in ids])
    within = sum(((x[labels == c] - m) ** 2).sum() for c, m in zip(ids, centre, strict=True))
    between = sum((labels == c).sum() * ((m - x.mean(axis=0)) ** 2).sum() for c, m in zip(ids, centre, strict=True))
    n, k = len(x), len(ids)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    s = []
    for i in range(n):
        own = labels == labels[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in ids if c != labels[i]) if k > 1 else 0.0
        s.append(0.0 if own.sum() == 1 else (b - a) / max(a, b, 1e-300))
    radius = [np.sqrt(((x[labels == c] - m) ** 2).sum(axis=1)).max() for c, m in zip(ids, centre, strict=True)]
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
    db = np.mean([max((radius[a] + radius[b]) / gap[a, b] for b in range(k) if b != a) for a in range(k)]) if k > 1 else 0.0
    return {"silhouette": float(np.mean(s)), "calinski_harabasz": float(between / max(1, k - 1) / (within / max(1, n - k))), "davies_bouldin": float(db)}


def adjusted_mutual_information(table):
    """AMI of a contingency table, with the exact expectation under permutation."""
    t = np.asarray(table, float)
    n, a, b = t.sum(), t.sum(axis=1), t.sum(axis=0)
    h = lambda p: -sum(x / n * math.log(x / n) for x in p if x > 0)
    mi = sum(t[i, j] / n * math.log(n * t[i, j] / (a[i] * b[j])) for i in range(len(a)) for j in range(len(b)) if t[i, j] > 0)
    g, expected = math.lgamma, 0.0
    for x in a:
        for y in b:
            for m in range(int(max(1, x + y - n)), int(min(x, y)) + 1):
                log = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1) - g(m + 1) - g(x - m + 1) - g(y - m + 1) - g(n - x - y + m + 1)
                expected += m / n * math.log(n * m / (x * y)) * math.exp(log)
    top = (h(a) + h(b)) / 2
    return 1.0 if abs(top - expected) < 1e-15 else (mi - expected) / (top - expected)


def simplex_weights(draws: int, parts: int, seed: int, low: float = 0.0, high: float = 1.0, most: int = 1_000_000):
    """Uniform weights on the simplex by exponentials; with bounds, those draws that keep to them."""
    rng = np.random.default_rng(seed)
    out: list = []
    for _ in range(most // max(1, draws) + 1):
        e = -np.log(1 - rng.random((draws, parts)))
        w = e / e.sum(axis=1, keepdims=True)
        out += w[(w >= low).all(axis=1) & (w <= high).all(axis=1)].tolist()
        if len(out) >= draws:
            return np.array(out[:draws])
    raise ValueError("the bounds leave too little of the simplex")


def couple_ranks(marginals, corr, seed: int = 0):
    """Draws of several marginals (rows: parts) reordered by Gaussian ranks, so that they are correlated and each keeps its values."""
    m = np.asarray(marginals, float)
    parts, n = m.shape
    z = np.random.default_rng(seed).normal(size=(n, parts)) @ np.linalg.cholesky(nearest_psd(np.asarray(corr, float))).T
    place = np.argsort(np.argsort(z, axis=0, kind="stable"), axis=0, kind="stable")
    return np.sort(m, axis=1)[np.arange(parts)[:, None], place.T]


def empirical_marginal(residuals, centre: float, low: float, high: float, draws: int):
    """Quantiles of residuals scaled on each side so that the 5 and 95 % points are the given bounds around the centre."""
    q = np.quantile(np.asarray(residuals, float), (np.arange(draws) + 0.5) / draws)
    q -= np.median(q)
    lo, hi = np.quantile(q, 0.05), np.quantile(q, 0.95)
    return centre + np.where(q < 0, q * ((centre - low) / -lo if lo < 0 else 0), q * ((high - centre) / hi if hi > 0 else 0))
