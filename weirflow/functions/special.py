"""Special functions that Spark lacks, as small array helpers for use in Arrow batches and on driver scalars."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2)).astype(float)


def gamma_cdf(x: np.ndarray, a: float, scale: float) -> np.ndarray:
    """Regularised lower incomplete gamma: power series below a + 1, continued fraction above."""
    x = np.maximum(np.asarray(x, float) / scale, 0.0)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        t = x[low]
        term = np.full_like(t, 1 / a)
        total = term.copy()
        n = a
        for _ in range(10_000):
            n += 1
            term = term * t / n
            total += term
            if np.all(term <= total * 1e-16):
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function has not converged")
        out[low] = total * np.exp(-t + a * np.log(t) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        t = x[high]
        tiny = 1e-300
        b = t + 1 - a
        c = np.full_like(t, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        else:
            raise ArithmeticError("the fraction of the incomplete gamma function has not converged")
        out[high] = 1 - np.exp(-t + a * np.log(t) - math.lgamma(a)) * h
    return out


def digamma(x: float) -> float:
    """Shift up by recurrence, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return out + math.log(x) - 0.5 / x - series


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h
    raise ArithmeticError("the fraction of the incomplete beta function has not converged")


def t_quantile(q: float, df: float | None) -> float:
    """Quantile above the median of Student's t (normal when `df` is None) by bisection."""

    def cdf(t: float) -> float:
        if df is None:
            return 1 - 0.5 * math.erfc(t / math.sqrt(2))
        return 1 - 0.5 * _beta_cdf(df / (df + t * t), df / 2, 0.5)

    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2
