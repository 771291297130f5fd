"""Two-sample tests of covariances whose samples stay in the rows of two tables: everything they need are sums over rows.

Gaussian multipliers: given the rows, a sum of centred products times independent standard normal numbers is itself a Gaussian vector, whose covariance is
the sum of the products' outer products. One such matrix per sample therefore gives the law of all replicates, and no row is read again for any of
them. Super-diagonals: sums over different rows are polynomials of sums over rows, and the variance is made of squares of small cross-product matrices.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.special import chi2_sf
from tessella.operators.gradients import WEIGHT_BYTES, Blocks
from tessella.operators.replicates import broadcast_samples, replicate

#: Rows whose products one task holds at a time, in numbers.
SLICE_NUMBERS = 1 << 22


def _slices(x: np.ndarray, width: int):
    step = max(1, SLICE_NUMBERS // max(width, 1))
    for at in range(0, len(x), step):
        yield x[at : at + step]


def _means(data: Blocks, what: str) -> np.ndarray:
    n, sums = data.sums(lambda x, *_: [x.sum(axis=0)], [])
    if n < 4:
        raise ValueError(f"{what} has {n} whole rows, 4 at least are needed")
    return sums[0] / n


def _product_law(data: Blocks, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of the products of all pairs of centred columns. Products are shifted by their first estimate, so that large ones
    don't cancel."""
    i, j = np.triu_indices(len(mean))

    def first(x: np.ndarray, weights: list[np.ndarray], *_) -> list[np.ndarray]:
        w = x - weights[0]
        return [(w.T @ w)[i, j]]

    def second(x: np.ndarray, weights: list[np.ndarray], *_) -> list[np.ndarray]:
        out = np.zeros((len(i), len(i)))
        for rows in _slices(x - weights[0], len(i)):
            d = rows[:, i] * rows[:, j] - weights[1]
            out += d.T @ d
        return [out]

    n, sums = data.sums(first, [mean])
    products = sums[0] / n
    return products, data.sums(second, [mean, products])[1][0] / n


def multiplier_law(x: DataFrame, y: DataFrame, columns: list[str]) -> tuple[float, np.ndarray]:
    """The statistic of hypothesis.multiplier_bootstrap() (largest standardised difference of covariance entries), and the covariance of the Gaussian
    vector whose largest absolute entry is its law. Rows with a missing value are left out. ValueError where a sample has fewer than 4 rows, or where
    columns are so many (over some 106) that the covariance of their products is larger than WEIGHT_BYTES."""
    pairs = len(columns) * (len(columns) + 1) // 2
    if 8 * pairs * pairs > WEIGHT_BYTES:
        raise ValueError(f"the products of {len(columns)} columns have a covariance of more than {WEIGHT_BYTES} bytes")
    gap, law = np.zeros(pairs), np.zeros((pairs, pairs))
    for sign, df, what in ((1, x, "the first sample"), (-1, y, "the second sample")):
        with Blocks(df, columns) as data:
            products, spread = _product_law(data, _means(data, what))
            gap, law = gap + sign * products, law + spread / data.n
    scale = np.sqrt(np.maximum(np.diag(law), 1e-300))
    return float(np.max(np.abs(gap) / scale)), law / np.outer(scale, scale)


def multiplier_bootstrap_rows(x: DataFrame, y: DataFrame, columns: list[str], replicates: int = 2500, seed: int = 0) -> tuple[float, float]:
    """Statistic and p-value of equal covariances, by the same law as hypothesis.multiplier_bootstrap() for samples of any number of rows: replicates are
    drawn from the law in tasks, which get its square root."""
    stat, law = multiplier_law(x, y, columns)
    values, vectors = np.linalg.eigh(law)
    kept = values > 1e-12 * max(values[-1], 0.0)
    shared = broadcast_samples(x.sparkSession, vectors[:, kept] * np.sqrt(values[kept]))

    def one(k: int) -> float:
        (root,) = shared.value
        return float(np.max(np.abs(root @ np.random.default_rng([seed, k]).standard_normal(root.shape[1])), initial=0.0))

    return stat, float(replicate(x.sparkSession, replicates, one).agg(F.avg((F.col("value") >= stat).cast("double"))).first()[0])


#: Exponents of a column and the one beyond it whose products' sums a super-diagonal needs.
POWERS = ((1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (2, 1), (1, 2), (2, 2))


def _pairs(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] - lag], x[:, lag:]


def _lag_sums(data: Blocks, mean: np.ndarray, lags: list[int]) -> list[dict[tuple[int, int], np.ndarray]]:
    """Per lag, sums over rows of a^i b^j for the exponents above, of centred columns."""

    def f(x: np.ndarray, weights: list[np.ndarray], *_) -> list[np.ndarray]:
        out = []
        for lag in lags:
            a, b = _pairs(x - weights[0], lag)
            out.append(np.stack([(a**i * b**j).sum(axis=0) for i, j in POWERS]))
        return out

    return [dict(zip(POWERS, s, strict=True)) for s in data.sums(f, [mean])[1]]


def _lag_spreads(data: Blocks, mean: np.ndarray, lags: list[int], sums: list[dict]) -> list[tuple[np.ndarray, float]]:
    """Per lag, cross products of the centred products z of the two columns, and the sum of |z|^4 over rows."""
    shifts = [s[1, 1] / (data.n - 1) for s in sums]

    def f(x: np.ndarray, weights: list[np.ndarray], *_) -> list[np.ndarray]:
        out = []
        for lag, shift in zip(lags, weights[1:], strict=True):
            a, b = _pairs(x - weights[0], lag)
            z = a * b - shift
            out += [z.T @ z, np.array([np.sum(np.sum(z * z, axis=1) ** 2)])]
        return out

    got = data.sums(f, [mean, *shifts])[1]
    return [(got[2 * k], float(got[2 * k + 1][0])) for k in range(len(lags))]


def _square(s: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
    """Unbiased squares of covariances: means of products over two, three and four different rows, from sums over rows by inclusion and exclusion."""
    a, b, ab, aa, bb, aab, abb, aabb = (s[e] for e in POWERS)
    two = ab**2 - aabb
    three = a * b * ab - a * abb - b * aab - ab**2 + 2 * aabb
    four = (a * b) ** 2 - aa * b**2 - bb * a**2 - 4 * a * b * ab + 4 * a * abb + 4 * b * aab + aa * bb + 2 * ab**2 - 6 * aabb
    return two / (n * (n - 1)) - 2 * three / (n * (n - 1) * (n - 2)) + four / (n * (n - 1) * (n - 2) * (n - 3))


def _covariances(s: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
    return s[1, 1] / n - (s[1, 0] * s[0, 1] - s[1, 1]) / (n * (n - 1))


def super_diagonal_rows(x: DataFrame, y: DataFrame, columns: list[str], lags: int | None = None) -> DataFrame:
    """replicate (the distance from the diagonal, 0 to lags; by default floor(p ** 0.7)), statistic, p: resampled.super_diagonal_p() of samples of any number of
    rows, three passes over each for all distances; hypothesis.benjamini_hochberg() makes the test of it. Rows with a missing value are left out. ValueError
    where a sample has fewer than 4 rows."""
    p = len(columns)
    distances = list(range((int(p**0.7) if lags is None else lags) + 1))
    found = []
    for df, what in ((x, "the first sample"), (y, "the second sample")):
        with Blocks(df, columns) as data:
            mean = _means(data, what)
            sums = _lag_sums(data, mean, distances)
            found.append((data.n, sums, _lag_spreads(data, mean, distances, sums)))
    (n, sx, zx), (m, sy, zy) = found
    rows = []
    for k in distances:
        gap = float(np.sum(_square(sx[k], n) + _square(sy[k], m) - 2 * _covariances(sx[k], n) * _covariances(sy[k], m)))
        own = sum(2 * (float(np.sum(g * g)) - fourth) / (c * (c - 1)) ** 2 for c, (g, fourth) in ((n, zx[k]), (m, zy[k])))
        var = own + 4 * float(np.sum(zx[k][0] * zy[k][0])) / (n * m) ** 2
        stat = gap**2 / var if var > 0 and not math.isnan(gap) else None
        rows.append((k, stat, None if stat is None else chi2_sf(stat, 1)))
    return x.sparkSession.createDataFrame(rows, "replicate long, statistic double, p double")
