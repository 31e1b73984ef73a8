"""Statistical functions from published formulas; NumPy arrays in and out."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """The normal quantile: a start from the logistic curve, then Newton steps on the error function."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    tail = np.minimum(p, 1 - p)
    x = -np.sqrt(np.maximum(-2 * np.log(2 * tail), 0))
    erfc = np.vectorize(math.erfc)
    for _ in range(60):
        f = 0.5 * erfc(-x / math.sqrt(2))
        density = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        step = (f - tail) / np.maximum(density, 1e-300)
        step = step / (1 + np.clip(0.5 * x * step, -0.5, 0.5))  # Halley's correction
        x = x - step
        if np.all(np.abs(step) < 1e-13):
            break
    return np.where(p < 0.5, x, -x)


def chi2_sf(x: float, df: float) -> float:
    """The upper tail of chi-square: a series below the mean, a continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    head = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - head * total
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def student_sf(t: float, df: float) -> float:
    """The two-sided tail of Student's t by the incomplete beta function."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def incomplete_beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a
