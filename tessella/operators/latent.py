"""Latent-factor models from moments: probabilistic PCA and its regularised, supervised and adversarial forms, factor analysis, missing data."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.covariance import ESTIMATORS, Covariance, woodbury_inverse
from tessella.operators.moments import Moments, moments


@dataclass
class FactorModel:
    """x = W's + noise: loadings w (factors x columns) and noise variances; mean is what rows are centred by."""

    w: np.ndarray
    noise: np.ndarray
    mean: np.ndarray

    def covariance(self) -> Covariance:
        return Covariance(self.w.T @ self.w + np.diag(self.noise))

    def noise_matrix(self) -> np.ndarray:
        return np.diag(self.noise)

    def projection(self, observed: list[int] | None = None) -> np.ndarray:
        """Factors given the observed columns (all by default): posterior means are centred rows times this matrix."""
        o = np.arange(self.w.shape[1]) if observed is None else np.flatnonzero(np.asarray(observed) == 1)
        return woodbury_inverse(self.w[:, o], self.noise[o]) @ self.w[:, o].T

    def transform(self, df: DataFrame, columns: list[str], observed: list[int] | None = None) -> DataFrame:
        """df with columns factor_0, factor_1, ...: linear forms of the (observed) columns, in the JVM."""
        g = self.projection(observed)
        o = np.arange(len(columns)) if observed is None else np.flatnonzero(np.asarray(observed) == 1)
        form = lambda k: sum(((F.col(f"`{columns[i]}`") - F.lit(float(self.mean[i]))) * F.lit(float(g[r, k])) for r, i in enumerate(o)), F.lit(0.0))
        return df.select("*", *[form(k).alias(f"factor_{k}") for k in range(g.shape[1])])


def _ppca(matrix: np.ndarray, mean: np.ndarray, factors: int) -> FactorModel:
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    noise = float(values[factors:].mean()) if factors < len(values) else 1e-12
    w = vectors[:, :factors].T * np.sqrt(np.maximum(values[:factors] - noise, 0))[:, None]
    return FactorModel(w, np.full(len(values), noise), mean)


def ppca(df: DataFrame, columns: list[str], factors: int, method: str | None = None) -> FactorModel:
    """Maximum-likelihood probabilistic PCA of a mean-zero matrix, or of a shrunk covariance if a method is named."""
    m = moments(df, columns)[None]
    zero = np.zeros(len(columns))
    if method is None:
        return _ppca(m.gram / (m.n - 1), zero, factors)
    return _ppca(ESTIMATORS[method](m.about_zero()), m.mean, factors)


def _augmented(m: Moments, p: int, pulls: list[tuple[slice, float]], factors: int, method: str, eps: float, sketch: int | None, seed: int) -> tuple[FactorModel, np.ndarray]:
    """Leading eigenvectors of the covariance augmented by each block of targets, pulled towards (positive) or pushed from (negative) it."""
    centred = m.about_zero()
    cov = ESTIMATORS[method](centred)
    b11 = cov[:p, :p]
    big = np.zeros_like(cov)
    big[:p, :p] = b11
    for rows, mu in pulls:
        cross = cov[:p, rows]
        big[:p, rows] = mu * cross
        big[rows, :p] = cross.T
        big[rows, rows] = mu * cross.T @ np.linalg.solve(b11 + eps * np.eye(p), cross)
    if sketch:
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(big @ rng.normal(size=(len(big), min(factors + sketch, len(big)))))[0]
        values, small = np.linalg.eig(basis.T @ big @ basis)
        vectors = basis @ small
    else:
        values, vectors = np.linalg.eig(big)
    order = np.argsort(-values.real)[:factors]
    w = vectors.real[:p, order]
    own = centred.gram[:p, :p] / m.n
    project = w @ np.linalg.pinv(w)
    residual = np.trace(own - 2 * project @ own + project @ own @ project.T) / p
    return FactorModel(w.T, np.full(p, max(residual, 1e-12)), m.mean[:p]), vectors.real[p:, order]


def supervised_ppca(df: DataFrame, columns: list[str], targets: list[str], factors: int, mu: float = 1.0, adversarial: bool = False, method: str = "Empirical", eps: float = 1e-8, sketch: int | None = None, seed: int = 0) -> tuple[FactorModel, np.ndarray]:
    """Factors that explain the columns and predict the targets, or with adversarial don't; and the targets' coefficients.

    sketch: oversampled columns of a randomised range finder, instead of the full decomposition.
    """
    m = moments(df, [*columns, *targets])[None]
    p = len(columns)
    return _augmented(m, p, [(slice(p, p + len(targets)), -mu if adversarial else mu)], factors, method, eps, sketch, seed)


def supervised_adversarial_ppca(df: DataFrame, columns: list[str], targets: list[str], confounders: list[str], factors: int, mu_s: float = 1.0, mu_a: float = 1.0, method: str = "Empirical", eps: float = 1e-8, sketch: int | None = None, seed: int = 0) -> tuple[FactorModel, np.ndarray]:
    """Both at once: towards the targets and away from the confounders."""
    m = moments(df, [*columns, *targets, *confounders])[None]
    p, q = len(columns), len(columns) + len(targets)
    return _augmented(m, p, [(slice(p, q), mu_s), (slice(q, q + len(confounders)), -mu_a)], factors, method, eps, sketch, seed)


def factor_analysis(df: DataFrame, columns: list[str], factors: int, rounds: int = 1000, tolerance: float = 1e-8) -> FactorModel:
    """Factor analysis with a noise variance per column, by expectation maximisation on the covariance."""
    m = moments(df, columns)[None]
    s = m.covariance(0)
    model = _ppca(s, m.mean, factors)
    w, noise = model.w, np.maximum(np.diag(s - model.w.T @ model.w), 1e-6)
    for _ in range(rounds):
        g = w @ woodbury_inverse(w, noise)
        cross = g @ s
        ess = np.eye(factors) - g @ w.T + cross @ g.T
        new = np.linalg.solve(ess, cross)
        new_noise = np.maximum(np.diag(s - new.T @ cross), 1e-9)
        change = np.abs(new_noise - noise).max()
        w, noise = new, new_noise
        if change < tolerance:
            break
    return FactorModel(w, noise, m.mean)


def ppca_missing(df: DataFrame, columns: list[str], factors: int, rounds: int = 200, tolerance: float = 1e-6) -> FactorModel:
    """Probabilistic PCA of centred rows with missing values, by expectation maximisation over patterns of missingness.

    Rows are reduced to moments per pattern (filled by 0 and grouped by mask) in one pass; every round works on those
    sums alone. Patterns are expected to be few against rows.
    """
    from tessella.operators.imputation import observed

    mask = F.concat(*[F.when(observed(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns])
    rows = df.select(mask.alias("mask"), *[F.coalesce(observed(c), F.lit(0.0)).alias(c) for c in columns])
    found = moments(rows, columns, "mask")
    p, n = len(columns), sum(m.n for m in found.values())
    seen = np.array([[c == "1" for c in key] for key in found])
    counts = np.array([m.n for m in found.values()])
    mean = sum(m.total for m in found.values()) / np.maximum((seen * counts[:, None]).sum(axis=0), 1)
    sigma = np.diag(np.maximum(sum(np.diag(m.gram) for m in found.values()) / np.maximum((seen * counts[:, None]).sum(axis=0), 1) - mean**2, 1e-6))
    model = _ppca(sigma + 1e-3 * np.eye(p), mean, factors)
    for _ in range(rounds):
        full = np.zeros((p, p))
        sigma = model.covariance().matrix
        for o, m in zip(seen, found.values(), strict=True):
            own = np.outer(o, o) * (m.gram - np.outer(m.total, mean) - np.outer(mean, m.total) + m.n * np.outer(mean, mean))
            a, b = np.flatnonzero(o), np.flatnonzero(~o)
            lift = np.zeros((p, p))
            lift[a, a] = 1
            if len(a) and len(b):
                lift[np.ix_(b, a)] = sigma[np.ix_(b, a)] @ np.linalg.inv(sigma[np.ix_(a, a)])
            full += lift @ own @ lift.T
            if len(b):
                rest = sigma[np.ix_(b, b)] - (lift[np.ix_(b, a)] @ sigma[np.ix_(a, b)] if len(a) else 0)
                full[np.ix_(b, b)] += m.n * rest
        new = _ppca(full / n, mean, factors)
        change = np.abs(new.w.T @ new.w - model.w.T @ model.w).max() + abs(new.noise[0] - model.noise[0])
        model = new
        if change < tolerance:
            break
    return model


def decision(columns: list[str], weights: np.ndarray, bias: np.ndarray) -> list[Column]:
    """Linear scores of each label."""
    return [sum((F.col(f"`{c}`") * F.lit(float(weights[i, k])) for i, c in enumerate(columns)), F.lit(float(bias[k]))) for k in range(weights.shape[1])]


def reduced_rank_logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, nuclear: float = 0.1, rounds: int = 500, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Multi-label logistic regression with entries and singular values of the weights shrunk, by proximal gradient steps."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    step = rate * 4 * len(x) / max(np.linalg.norm(x, 2) ** 2, 1e-12)
    for _ in range(rounds):
        err = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y
        w = w - step * x.T @ err / len(x)
        b = b - rate * err.mean(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        u, s, vt = np.linalg.svd(w, full_matrices=False)
        w = (u * np.maximum(s - step * nuclear, 0)) @ vt
    return w, b


def mrf_nce(x: np.ndarray, noise_ratio: int = 5, rounds: int = 400, rate: float = 0.05, l2: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Pairwise Markov random field of binary columns, fitted against independent noise: fields, interactions, log partition."""
    rng = np.random.default_rng(seed)
    q = np.clip(x.mean(axis=0), 0.01, 0.99)
    p = x.shape[1]
    h, j, z = np.log(q / (1 - q)), np.zeros((p, p)), float(np.sum(-np.log(1 - q)))
    log_q = lambda a: a @ np.log(q) + (1 - a) @ np.log(1 - q)
    for _ in range(rounds):
        fake = (rng.random((noise_ratio * len(x), p)) < q).astype(float)
        both = np.vstack([x, fake])
        energy = both @ h + 0.5 * np.sum((both @ j) * both, axis=1) - z
        odds = energy - log_q(both) - np.log(noise_ratio)
        err = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - np.r_[np.ones(len(x)), np.zeros(len(fake))]) / len(x)
        h = h - rate * (both.T @ err)
        grad = (both * err[:, None]).T @ both / 2 + l2 * j
        np.fill_diagonal(grad, 0)
        j = j - rate * (grad + grad.T) / 2
        z = z + rate * err.sum()
    return h, j, z


def mrf_score(x: np.ndarray, h: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unnormalised log probability of each row."""
    return x @ h + 0.5 * np.sum((x @ j) * x, axis=1)


def sgld(grad, start: np.ndarray, steps: int, a: float = 1e-3, b: float = 10.0, gamma: float = -0.55, seed: int = 0) -> np.ndarray:
    """Stochastic-gradient Langevin draws of a density with energy gradient grad(x, rng): one row per step."""
    rng, x, out = np.random.default_rng(seed), start.astype(float).copy(), np.zeros((steps, len(start)))
    for t in range(steps):
        rate = a * (b + t) ** gamma
        x = x - rate * grad(x, rng) + rng.normal(size=x.shape) * np.sqrt(2 * rate)
        out[t] = x
    return out


def preconditioned_sgld(grad, start: np.ndarray, steps: int, rate: float = 1e-3, beta: float = 0.99, damping: float = 1e-5, seed: int = 0) -> np.ndarray:
    """The same with each coordinate scaled by the running root mean square of its gradient."""
    rng, x, out = np.random.default_rng(seed), start.astype(float).copy(), np.zeros((steps, len(start)))
    square = np.zeros_like(x)
    for t in range(steps):
        g = grad(x, rng)
        square = beta * square + (1 - beta) * g * g
        scale = np.sqrt(square) + damping
        x = x - rate * g / scale + rng.normal(size=x.shape) * np.sqrt(2 * rate / scale)
        out[t] = x
    return out
