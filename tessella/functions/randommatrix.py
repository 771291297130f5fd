"""Distributions of eigenvalues of random matrices: Marchenko-Pastur, largest Wishart eigenvalue, Wishart spike, Tracy-Widom."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.special import bisect, normal_cdf, normal_quantile

NODES, WEIGHTS = np.polynomial.legendre.leggauss(60)


def airy(x: np.ndarray) -> np.ndarray:
    """Airy's Ai for x from about -15 on: its contour integral on the ray of angle pi/6, where the integrand decays as exp(-t^3/3)."""
    x = np.asarray(x, dtype=float)
    t, w = np.polynomial.legendre.leggauss(160)
    t, w = 6 * (t + 1), 6 * w
    ray = np.exp(1j * np.pi / 6)
    values = np.exp(-(t**3) / 3 + 1j * x[..., None] * t * ray) * ray
    return (values * w).sum(axis=-1).real / np.pi


@lru_cache(maxsize=100_000)
def _determinants(s: float) -> tuple[float, float]:
    """det(I - V) and det(I + V) for the kernel V(x, y) = Ai((x + y) / 2) / 2 on (s, infinity), by quadrature of the kernel."""
    span = max(16.0 - s, 8.0)
    x = s + span * (NODES + 1) / 2
    root = np.sqrt(WEIGHTS * span / 2)
    v = root[:, None] * airy((x[:, None] + x[None, :]) / 2) / 2 * root[None, :]
    return float(np.linalg.det(np.eye(len(x)) - v)), float(np.linalg.det(np.eye(len(x)) + v))


def tracy_widom_cdf(s: float, beta: int = 1) -> float:
    """beta 1: det(I - V); 2: det(I - V) det(I + V); 4: their mean, at s * sqrt(2)."""
    if beta not in (1, 2, 4):
        raise ValueError("beta is 1, 2 or 4")
    if beta == 4:
        s = s * math.sqrt(2)
    if s < -12:
        return 0.0
    if s > 14:
        return 1.0
    minus, plus = _determinants(float(s))
    return min(1.0, max(0.0, {1: minus, 2: minus * plus, 4: (minus + plus) / 2}[beta]))


def tracy_widom_pdf(s: float, beta: int = 1, h: float = 2e-3) -> float:
    f = lambda k: tracy_widom_cdf(s + k * h, beta)
    return max(0.0, (8 * (f(1) - f(-1)) - (f(2) - f(-2))) / (12 * h))


def tracy_widom_quantile(p: float, beta: int = 1) -> float:
    return bisect(lambda s: tracy_widom_cdf(s, beta) - p, -12.0, 14.0, 60)


def tracy_widom_random(n: int, beta: int = 1, seed: int = 0) -> np.ndarray:
    """Draws through an interpolated quantile function."""
    grid = np.linspace(-8, 6, 561)
    return np.interp(np.random.default_rng(seed).random(n), [tracy_widom_cdf(s, beta) for s in grid], grid)


@dataclass(frozen=True)
class MarchenkoPastur:
    """Eigenvalues of a sample covariance of ndf rows and pdim columns of variance var; svr: ndf / pdim unless given."""

    ndf: float
    pdim: float
    var: float = 1.0
    svr: float | None = None

    @property
    def ratio(self) -> float:
        return self.svr if self.svr is not None else self.ndf / self.pdim

    @property
    def edges(self) -> tuple[float, float]:
        r = math.sqrt(1 / self.ratio)
        return self.var * (1 - r) ** 2, self.var * (1 + r) ** 2

    def pdf(self, x: float) -> float:
        low, high = self.edges
        return self.ratio / (2 * math.pi * self.var * x) * math.sqrt((x - low) * (high - x)) if low < x < high else 0.0

    def cdf(self, x: float) -> float:
        """With fewer rows than columns, 1 - ratio of the eigenvalues are 0."""
        low, high = self.edges
        atom = max(0.0, 1 - self.ratio)
        if x <= low:
            return atom if x >= 0 else 0.0
        if x >= high:
            return 1.0
        middle, half = (low + high) / 2, (high - low) / 2
        end = math.acos(max(-1.0, min(1.0, (middle - x) / half)))
        theta = end * (NODES + 1) / 2
        y = middle - half * np.cos(theta)
        mass = np.sum(WEIGHTS * self.ratio / (2 * math.pi * self.var * y) * (half * np.sin(theta)) ** 2) * end / 2
        return min(1.0, atom + float(mass))

    def quantile(self, p: float) -> float:
        low, high = self.edges
        return 0.0 if p <= max(0.0, 1 - self.ratio) else bisect(lambda x: self.cdf(x) - p, low, high)

    def random(self, n: int, seed: int = 0) -> np.ndarray:
        low, high = self.edges
        grid = np.linspace(low, high, 2001)
        u = np.random.default_rng(seed).random(n)
        return np.where(u <= max(0.0, 1 - self.ratio), 0.0, np.interp(u, [self.cdf(x) for x in grid], grid))


def mp_density(x: Column, ratio: float, var: float = 1.0) -> Column:
    """The density as a Column."""
    low, high = MarchenkoPastur(1, 1, var, ratio).edges
    inside = (x > low) & (x < high)
    return F.when(inside, F.lit(ratio / (2 * math.pi * var)) / x * F.sqrt((x - low) * (high - x))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class WishartMax:
    """Largest eigenvalue of a white Wishart matrix: a shifted and scaled Tracy-Widom law."""

    ndf: float
    pdim: float
    var: float = 1.0
    beta: int = 1

    @property
    def parameters(self) -> tuple[float, float]:
        n = self.ndf - 0.5 if self.beta == 1 else self.ndf + 0.5
        p = self.pdim - 0.5 if self.beta == 1 else self.pdim + 0.5
        if self.beta not in (1, 2):
            raise ValueError("beta is 1 or 2")
        both = math.sqrt(n) + math.sqrt(p)
        return self.var * both**2 / self.ndf, self.var * both * (1 / math.sqrt(n) + 1 / math.sqrt(p)) ** (1 / 3) / self.ndf

    def pdf(self, x: float) -> float:
        centre, scale = self.parameters
        return tracy_widom_pdf((x - centre) / scale, self.beta) / scale

    def cdf(self, x: float) -> float:
        centre, scale = self.parameters
        return tracy_widom_cdf((x - centre) / scale, self.beta)

    def quantile(self, p: float) -> float:
        centre, scale = self.parameters
        return centre + scale * tracy_widom_quantile(p, self.beta)


@dataclass(frozen=True)
class WishartSpike:
    """Sample eigenvalue of a spike: normal above the phase transition, undefined (NaN) below."""

    spike: float
    ndf: float
    pdim: float
    var: float = 1.0
    beta: int = 1

    @property
    def parameters(self) -> tuple[float, float]:
        ratio = self.pdim / self.ndf
        if self.spike <= math.sqrt(ratio) * self.var:
            return math.nan, math.nan
        centre = (self.spike + self.var) * (1 + ratio * self.var / self.spike)
        scale = (self.spike + self.var) * math.sqrt(2 / self.beta * (1 - ratio * (self.var / self.spike) ** 2)) / math.sqrt(self.ndf)
        return centre, scale

    def pdf(self, x: float) -> float:
        centre, scale = self.parameters
        return math.exp(-(((x - centre) / scale) ** 2) / 2) / (scale * math.sqrt(2 * math.pi))

    def cdf(self, x: float) -> float:
        centre, scale = self.parameters
        return normal_cdf((x - centre) / scale)

    def quantile(self, p: float) -> float:
        centre, scale = self.parameters
        return centre + scale * normal_quantile(p)

    def random(self, n: int, seed: int = 0) -> np.ndarray:
        centre, scale = self.parameters
        return np.random.default_rng(seed).normal(centre, scale, n)


def wishart_max_parameters(n: Column, p: Column) -> tuple[Column, Column]:
    """Centre and scale for beta 1 and unit variance as Columns."""
    a, b = F.sqrt(n - 0.5), F.sqrt(p - 0.5)
    return (a + b) * (a + b) / n, (a + b) * F.cbrt(1 / a + 1 / b) / n
