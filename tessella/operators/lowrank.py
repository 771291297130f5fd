"""Low-rank models of matrices whose rows are a table's rows and whose cells may be missing: nuclear-norm completion and probabilistic PCA.

The nuclear norm of Z = A B' is the least (|A|^2 + |B|^2) / 2 over all such factors, so completion alternates two ridge regressions (Hastie, Mazumder, Lee
and Zadeh 2015): a row's factors follow from its own observed cells and B, a column's from sums over rows. A pass over the rows takes B to the tasks and brings
columns x rank^2 numbers back, whatever the number of rows and of patterns of missing cells; row factors are made where they are needed and kept nowhere, so
a lost executor costs its blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.gradients import WEIGHT_BYTES, Blocks, Sums
from tessella.operators.imputation import observed
from tessella.operators.latent import FactorModel

#: Numbers of row equations that a task holds at a time; the least ridge, for rows and columns without an observed cell.
SLICE_NUMBERS, LEAST_RIDGE = 1 << 21, 1e-9

#: Parts of a million, in which the share of held-out cells is measured.
PARTS = 1_000_000


def _slices(x: np.ndarray, rank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which cells are observed (0 or 1), and the cells with 0 for missing ones; few enough rows at a time for rank^2 numbers each."""
    step = max(1, SLICE_NUMBERS // max(rank * rank, x.shape[1], 1))
    for at in range(0, len(x), step):
        seen = ~np.isnan(x[at : at + step])
        yield seen.astype(float), np.where(seen, x[at : at + step], 0.0)


def _outer(a: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)


def _row_equations(seen: np.ndarray, cells: np.ndarray, loadings: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row, B'B + ridge and B'x over its observed cells."""
    r = loadings.shape[1]
    return (seen @ _outer(loadings)).reshape(-1, r, r) + max(ridge, LEAST_RIDGE) * np.eye(r), cells @ loadings


def row_factors(x: np.ndarray, loadings: np.ndarray, ridge: float) -> np.ndarray:
    """Factors of each row of x (NaN: missing) given the loadings (columns x rank); 0 for a row without an observed cell."""
    parts = [np.linalg.solve(g, h[:, :, None])[:, :, 0] for g, h in (_row_equations(*s, loadings, ridge) for s in _slices(x, loadings.shape[1]))]
    return np.concatenate(parts) if parts else np.zeros((0, loadings.shape[1]))


def _column_equations(x: np.ndarray, loadings: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Per column, sums of A'A and of A'x over the rows that observe it, A being the row factors given the loadings."""
    p, r = loadings.shape
    gram, right = np.zeros((p, r * r)), np.zeros((p, r))
    for seen, cells in _slices(x, r):
        g, h = _row_equations(seen, cells, loadings, ridge)
        a = np.linalg.solve(g, h[:, :, None])[:, :, 0]
        gram, right = gram + seen.T @ _outer(a), right + cells.T @ a
    return gram, right


def _solve(gram: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    r = right.shape[-1]
    return np.linalg.solve(gram.reshape(-1, r, r) + max(ridge, LEAST_RIDGE) * np.eye(r), right[:, :, None])[:, :, 0]


def _masked(x: np.ndarray, p: int, folds: int, fold: int) -> np.ndarray:
    """The cells without those that the fold holds out; behind the p columns stand their folds as bits."""
    return np.where(x[:, p:].astype(np.int64) >> fold & 1, np.nan, x[:, :p]) if folds else x


def _half_step(p: int, folds: int) -> Sums:
    """Column equations of all pairs of strength and fold; weights: loadings (pairs x columns x rank) and strengths (pairs)."""

    def f(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
        found = [_column_equations(_masked(x, p, folds, k % max(folds, 1)), b, ridge) for k, (b, ridge) in enumerate(zip(*weights, strict=True))]
        return [np.stack(part) for part in zip(*found, strict=True)]

    return f


def _alternate(data: Blocks, p: int, strengths: np.ndarray, loadings: np.ndarray, rounds: int, tolerance: float, folds: int = 0) -> np.ndarray:
    """Loadings of every strength, one pass over the blocks a round for all of them, until none changes by more than tolerance relatively."""
    step = _half_step(p, folds)
    for _ in range(rounds):
        n, sums = data.sums(step, [loadings, strengths])
        if not n:
            break
        new = np.stack([_solve(g, h, ridge) for g, h, ridge in zip(*sums, strengths, strict=True)])
        change = np.linalg.norm(new - loadings, axis=(1, 2)) / np.maximum(np.linalg.norm(loadings, axis=(1, 2)), 1e-12)
        loadings = new
        if change.max() <= tolerance:
            break
    return loadings


def _start(p: int, rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(p, rank))


def soft_impute_rows(df: DataFrame, columns: list[str], shrinkage: float, rank: int, rounds: int = 100, tolerance: float = 1e-4, seed: int = 2021, start: np.ndarray | None = None) -> np.ndarray:
    """Loadings (columns x rank) of the completion that soft_impute() finds at this shrinkage, if its rank is at most rank; fill_low_rank() fills
    the table with them. start: loadings to begin with. A table without rows leaves them as they begin."""
    begin = _start(len(columns), rank, seed) if start is None else np.asarray(start, dtype=float)
    with Blocks(df.select(*[observed(c).alias(c) for c in columns]), columns, missing=True) as data:
        return _alternate(data, len(columns), np.array([float(shrinkage)]), begin[None], rounds, tolerance)[0]


def nuclear_norm_rows(df: DataFrame, columns: list[str], rank: int, tolerance: float = 1e-3, rounds: int = 50, seed: int = 2021) -> np.ndarray:
    """Loadings of the completion of least nuclear norm that (nearly) agrees with the observed cells: strengths fall by tenths, from the largest column norm
    to tolerance, each beginning with the loadings of the one before."""
    with Blocks(df.select(*[observed(c).alias(c) for c in columns]), columns, missing=True) as data:
        n, sums = data.sums(lambda x, *_: [np.nansum(x * x, axis=0)], [])
        level, loadings = float(np.sqrt(sums[0].max())) if n else 0.0, _start(len(columns), rank, seed)[None]
        while level > tolerance:
            level = max(level / 10, tolerance)
            loadings = _alternate(data, len(columns), np.array([level]), loadings, rounds, 1e-4)
    return loadings[0]


def held_out_folds(df: DataFrame, row_id: str, columns: list[str], folds: int, share: float, seed: int) -> list[Column]:
    """Per column, the folds that hold a row's cell out as bits of an integer: a hash of seed, fold, row and column decides, so a cell's folds
    don't depend on partitions. Equal row ids share them."""
    held = lambda fold, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(fold), F.col(f"`{row_id}`"), F.lit(k)), F.lit(PARTS)) < round(share * PARTS)
    return [sum((F.when(held(fold, k), 1 << fold).otherwise(0) for fold in range(folds)), F.lit(0)) for k in range(len(columns))]


def soft_impute_cv_rows(df: DataFrame, row_id: str, columns: list[str], rank: int, strengths: int = 10, folds: int = 3, held_out: float = 0.05, rounds: int = 30, tolerance: float = 1e-4, seed: int = 2021) -> tuple[np.ndarray, float, np.ndarray]:
    """Loadings at the strength in 10^[-2, 2] that explains most variance of held-out cells on average (ties: the smallest), that strength, and the scores
    (strengths x folds; 0 where a fold holds nothing out). All strengths and folds share each pass over the rows."""
    p, grid = len(columns), np.logspace(-2, 2, strengths)
    ridges = np.repeat(grid, folds)
    bits = held_out_folds(df, row_id, columns, folds, held_out, seed)
    coded = df.select(*[observed(c).alias(f"x{k}") for k, c in enumerate(columns)], *[b.alias(f"f{k}") for k, b in enumerate(bits)])

    def score(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
        out = np.zeros((len(ridges), 4))
        for k, (b, ridge) in enumerate(zip(*weights, strict=True)):
            cells = _masked(x, p, folds, k % folds)
            out_cells = np.isnan(cells) & ~np.isnan(x[:, :p])
            truth, guess = x[:, :p][out_cells], (row_factors(cells, b, ridge) @ b.T)[out_cells]
            out[k] = len(truth), truth.sum(), truth @ truth, np.sum((truth - guess) ** 2)
        return [out]

    with Blocks(coded, coded.columns, missing=True) as data:
        begin = np.repeat(_start(p, rank, seed)[None], len(ridges), axis=0)
        fitted = _alternate(data, p, ridges, begin, rounds, tolerance, folds)
        n, sums = data.sums(score, [fitted, ridges])
        count, total, squares, errors = sums[0].T if n else np.zeros((4, len(ridges)))
        spread = squares - total**2 / np.maximum(count, 1)
        scores = np.where(count > 0, 1 - errors / np.maximum(spread, 1e-300), 0.0).reshape(strengths, folds)
    best = float(grid[int(np.argmax(scores.mean(axis=1)))])
    return soft_impute_rows(df, columns, best, rank, seed=seed), best, scores


def fill_low_rank(df: DataFrame, columns: list[str], loadings: np.ndarray, ridge: float, mean: np.ndarray | None = None) -> DataFrame:
    """df with missing cells (null, NaN) of columns filled by the row's factors times the loadings (and the mean, by which rows are centred first); observed
    cells and other columns stay as they are. One pass without a shuffle."""
    if loadings.nbytes > WEIGHT_BYTES:
        raise ValueError(f"loadings of more than {WEIGHT_BYTES} bytes cannot be sent to every task")
    wanted = set(columns)
    cast = df.select(*[observed(c) if c in wanted else F.col(f"`{c}`") for c in df.columns]).toDF(*[f"c{k}" for k in range(len(df.columns))])
    at = [df.columns.index(c) for c in columns]
    shared = df.sparkSession.sparkContext.broadcast((loadings, np.zeros(len(columns)) if mean is None else np.asarray(mean, dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, centre = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in at]).astype(float) - centre
            x = np.where(np.isnan(x), row_factors(x, b, ridge) @ b.T, x) + centre
            arrays = list(batch.columns)
            for k, i in enumerate(at):
                arrays[i] = pa.array(x[:, k])
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return cast.mapInArrow(run, cast.schema).toDF(*df.columns)


def _expectation(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
    """Per column, sums over rows that observe it of E[zz'] and of x E[z], z being a row's factors given its observed cells."""
    w, noise, mean = weights
    p, k = w.shape
    second, cross = np.zeros((p, k * k)), np.zeros((p, k))
    for seen, cells in _slices(x - mean, k):
        g, h = _row_equations(seen, cells, w, float(noise[0]))
        inverse = np.linalg.inv(g)
        z = np.einsum("nij,nj->ni", inverse, h)
        second, cross = second + seen.T @ (_outer(z) + noise[0] * inverse.reshape(len(z), -1)), cross + cells.T @ z
    return [second, cross]


def ppca_missing_rows(df: DataFrame, columns: list[str], factors: int, rounds: int = 300, tolerance: float = 1e-6, seed: int = 2021, start: tuple[np.ndarray, float] | None = None) -> FactorModel:
    """Probabilistic PCA of rows with missing values, centred by the observed means, by expectation maximisation: the expectation step runs where the rows
    are, so the driver gets columns x factors^2 numbers a round, not a matrix per pattern as in latent.ppca_missing(). start: loadings (columns x factors) and
    noise variance. ValueError on a table without an observed cell."""
    p = len(columns)
    with Blocks(df.select(*[observed(c).alias(c) for c in columns]), columns, missing=True) as data:
        n, sums = data.sums(lambda x, *_: [(~np.isnan(x)).sum(axis=0).astype(float), np.nansum(x, axis=0)], [])
        if not n or not sums[0].sum():
            raise ValueError("no observed cells to fit on")
        counts = sums[0]
        mean = sums[1] / np.maximum(counts, 1)
        squares = data.sums(lambda x, weights, *_: [np.nansum((x - weights[0]) ** 2, axis=0)], [mean])[1][0]
        spread = np.maximum(squares / np.maximum(counts, 1), 1e-6)
        if start is None:
            w, noise = np.random.default_rng(seed).normal(size=(p, factors)) * np.sqrt(spread / (2 * factors))[:, None], float(spread.mean() / 2)
        else:
            w, noise = np.asarray(start[0], dtype=float), float(start[1])
        for _ in range(rounds):
            second, cross = data.sums(_expectation, [w, np.array([noise]), mean])[1]
            new = _solve(second, cross, 0.0)
            fitted = np.einsum("pi,pij,pj->p", new, second.reshape(p, factors, factors), new) - 2 * np.sum(new * cross, axis=1)
            new_noise = max(float((squares + fitted).sum() / counts.sum()), 1e-12)
            change = np.abs(new @ new.T - w @ w.T).max() + abs(new_noise - noise)
            w, noise = new, new_noise
            if change <= tolerance * spread.max():
                break
    return FactorModel(w.T, np.full(p, noise), mean)
