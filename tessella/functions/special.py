"""Distribution functions on plain floats: normal, chi-squared, F and gamma, without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

TINY = 1e-300


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or TINY)
        c = (b + an / c) or TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or TINY)
            c = (1 + num / c) or TINY
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1 - beta_cdf(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 1.0


def gamma_quantile(a: float, p: float) -> float:
    """The x with gamma_sf(a, x) = 1 - p, by bisection."""
    low, high = 0.0, max(1.0, a)
    while gamma_sf(a, high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_sf(a, mid) > 1 - p else (low, mid)
    return (low + high) / 2


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """A zero of an increasing f in [low, high]."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def inverse_softplus(x):
    """log(exp(x) - 1) of any x above zero, however small or large."""
    return x + np.log(-np.expm1(-x))
