"""Distribution functions for p-values and goodness of fit (numpy only).

Called on a handful of aggregated rows (tests) or on Arrow batches (fit).
"""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(np.asarray(x, dtype=float) / math.sqrt(2.0)))


def gamma_p(a: float, x) -> np.ndarray:
    """Regularised lower incomplete gamma, series below a+1 and Lentz fraction above."""
    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        z = x[low]
        term = np.full_like(z, 1.0 / a)
        total = term.copy()
        k = a
        for _ in range(2000):
            k += 1.0
            term = term * z / k
            total += term
            if np.all(np.abs(term) <= np.abs(total) * 1e-16):
                break
        out[low] = total * np.exp(-z + a * np.log(z) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        z = x[high]
        tiny = 1e-300
        b = z + 1.0 - a
        c = np.full_like(z, 1.0 / tiny)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1.0 / d
            step = d * c
            h *= step
            if np.all(np.abs(step - 1.0) < 1e-15):
                break
        out[high] = 1.0 - np.exp(-z + a * np.log(z) - math.lgamma(a)) * h
    return out


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coefficient / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_i(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    if inside.any():
        z = x[inside]
        front = np.exp(
            math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(z) + b * np.log1p(-z)
        )
        direct = z < (a + 1.0) / (a + b + 2.0)
        value = np.empty_like(z)
        if direct.any():
            value[direct] = front[direct] * _beta_fraction(a, b, z[direct]) / a
        if (~direct).any():
            value[~direct] = 1.0 - front[~direct] * _beta_fraction(b, a, 1.0 - z[~direct]) / b
        out[inside] = value
    return out


def digamma(x: float) -> float:
    """Derivative of the logarithm of gamma: recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    """Derivative of ``digamma``."""
    out = 0.0
    while x < 10:
        out, x = out + 1 / (x * x), x + 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def gamma_shape(mean: float, log_mean: float) -> float | None:
    """The likeliest shape of a gamma distribution from the mean and the mean logarithm, by Newton steps; null if all values are equal."""
    s = math.log(mean) - log_mean
    if s <= 1e-12:
        return None
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(a) - digamma(a) - s) / (1 / a - trigamma(a))
        a = a - step if step < a else a / 2
        if abs(step) < 1e-12 * a:
            break
    return a


def beta_shapes(log_mean: float, log_rest: float, a: float, b: float) -> tuple[float, float]:
    """The likeliest shapes of a beta distribution from the means of ``ln x`` and ``ln(1 - x)``, by Newton steps from ``a, b``."""
    for _ in range(100):
        whole, curve = digamma(a + b), trigamma(a + b)
        g, h = digamma(a) - whole - log_mean, digamma(b) - whole - log_rest
        p, q = trigamma(a) - curve, trigamma(b) - curve
        det = p * q - curve * curve
        da, db = (g * q + h * curve) / det, (h * p + g * curve) / det
        a, b = (a - da if da < a else a / 2), (b - db if db < b else b / 2)
        if abs(da) < 1e-12 * a and abs(db) < 1e-12 * b:
            break
    return a, b


def student_two_sided(t: float, df: float) -> float:
    return float(beta_i(df / 2.0, 0.5, np.array([df / (df + t * t)]))[0])


def chi_square_tail(x: float, df: float) -> float:
    return float(1.0 - gamma_p(df / 2.0, np.array([x / 2.0]))[0])


def kolmogorov_tail(d: float, n: float) -> float:
    """Asymptotic two-sided p-value of the KS statistic."""
    root = math.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    if lam < 1e-3:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * lam) ** 2) for k in range(1, 101))
    return max(0.0, min(1.0, 2.0 * total))


def cdf(name: str, x: np.ndarray, params: dict) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    if name == "norm":
        return normal_cdf((x - params["mean"]) / params["stddev"])
    if name == "expon":
        return 1.0 - np.exp(-np.maximum(x - params["loc"], 0.0) / params["scale"])
    if name == "lognorm":
        out = np.zeros_like(x)
        positive = x > 0
        out[positive] = normal_cdf((np.log(x[positive]) - params["log_mean"]) / params["log_stddev"])
        return out
    if name == "gamma":
        return gamma_p(params["shape"], (x - params["loc"]) / params["scale"])
    if name == "beta":
        return beta_i(params["a"], params["b"], (x - params["loc"]) / params["scale"])
    raise ValueError(name)
