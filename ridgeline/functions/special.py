"""Distribution functions in NumPy: normal, t, F, chi-square (central and noncentral)."""

from __future__ import annotations

import math

import numpy as np


def _each(f, x):
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel().tolist()], float).reshape(x.shape)


def _erfc(x):
    return _each(math.erfc, x)


def lgamma(x):
    return _each(math.lgamma, x)


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / math.sqrt(2 * math.pi)


def log_norm_cdf(x):
    """log of the normal CDF; far in the lower tail by its continued fraction."""
    x = np.asarray(x, float)
    out = np.log(np.maximum(norm_cdf(x), 1e-300))
    tail = x < -30
    if tail.any():
        t = -x[tail]
        f = t.copy()
        for k in range(40, 0, -1):
            f = t + k / f
        out = np.where(tail, 0.0, out)
        out[tail] = -0.5 * t * t - 0.5 * math.log(2 * math.pi) - np.log(f)
    return out


def solve_monotone(f, p: float, lo: float, hi: float) -> float:
    """x with f(x) = p for a rising f, by bisection after widening [lo, hi]."""
    for _ in range(200):
        if f(hi) >= p:
            break
        hi = hi * 2 + 1
    for _ in range(200):
        if f(lo) <= p:
            break
        lo = lo * 2 - 1
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if f(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, abs(hi)):
            break
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    return solve_monotone(lambda x: float(norm_cdf(x)), p, -10, 10)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + n * d) or 1e-300)
            c = (1 + n / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic; normal where df is infinite."""
    if not math.isfinite(t) or not df > 0:
        return math.nan
    if math.isinf(df):
        return float(2 * norm_cdf(-abs(t)))
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_ppf(p)
    cdf = lambda x: 1 - t_sf2(x, df) / 2 if x >= 0 else t_sf2(x, df) / 2
    return solve_monotone(cdf, p, -10, 10)


def chi2_sf(x: float, k: float) -> float:
    return math.nan if not math.isfinite(x) or k <= 0 else 1 - gamma_p(k / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    if not math.isfinite(f) or not d1 > 0 or not d2 > 0:
        return math.nan
    return chi2_sf(f * d1, d1) if math.isinf(d2) else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def f_ppf(p: float, d1: float, d2: float) -> float:
    return solve_monotone(lambda x: 1 - f_sf(x, d1, d2) if x > 0 else 0.0, p, 0.0, 10.0)


def ncx2_cdf(x: float, k: float, nc: float) -> float:
    """Noncentral chi-square CDF as a Poisson mixture of central ones, summed about its largest weight."""
    mid = int(nc / 2)
    weight = lambda j: math.exp(-nc / 2 + j * math.log(nc / 2) - math.lgamma(j + 1)) if nc > 0 else float(j == 0)
    width = int(12 * math.sqrt(nc / 2 + 1)) + 30
    return sum(weight(j) * gamma_p(k / 2 + j, x / 2) for j in range(max(0, mid - width), mid + width))


def ncx2_ppf(p: float, k: float, nc: float) -> float:
    return solve_monotone(lambda x: ncx2_cdf(x, k, nc), p, 0.0, k + nc + 10)
