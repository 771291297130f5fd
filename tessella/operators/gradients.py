"""Models fitted by gradients that are summed where the rows are: one optimiser loop for all, weights broadcast, one vector back per round.

Rows are packed once into blocks of numbers and kept (in memory, on disk where that is short; recomputed where an executor is lost). A round computes each
partition's sum over its blocks, adds the partitions' sums up in groups, and takes a step on the driver. Rounds may take a part of the blocks,
drawn by a hash of seed, round and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.covariance import woodbury_inverse
from tessella.operators.latent import FactorModel

#: Rows to a block; bytes of weights that may be broadcast each round.
BLOCK_ROWS, WEIGHT_BYTES = 8192, 256 << 20

Sums = Callable[[np.ndarray, list[np.ndarray], int, int], list[np.ndarray]]


class Blocks:
    """Numeric columns of df in blocks of rows; rows with a missing value in any column are left out, or with missing they stay, NaN where they miss
    one. Use as a context: blocks are released at its end."""

    def __init__(self, df: DataFrame, columns: list[str], missing: bool = False):
        p = self.p = len(columns)
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)])

        def pack(batches):
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) if batch.num_rows else np.zeros((0, p))
                x = x if missing else x[~np.isnan(x).any(axis=1)]
                parts = [np.ascontiguousarray(x[at : at + BLOCK_ROWS]).tobytes() for at in range(0, len(x), BLOCK_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array([len(b) // (8 * p) for b in parts], pa.int64()), pa.array(parts, pa.binary())], names=["n", "rows"])

        packed = rows.mapInArrow(pack, "n long, rows binary").withColumn("block", F.monotonically_increasing_id())
        self.blocks = packed.persist(StorageLevel.MEMORY_AND_DISK)
        self.n = int(self.blocks.agg(F.sum("n")).first()[0] or 0)
        self.fan = max(1, math.isqrt(self.blocks.rdd.getNumPartitions()))

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.blocks.unpersist()

    def sums(self, f: Sums, weights: list[np.ndarray], turn: int = 0, seed: int = 0, share: float = 1.0) -> tuple[int, list[np.ndarray]]:
        """Rows taken and the sums of f(rows, weights, block, turn) over blocks; share: of the blocks, drawn anew each turn. The driver gets as many
        vectors as the square root of the number of partitions."""
        if sum(w.nbytes for w in weights) > WEIGHT_BYTES:
            raise ValueError(f"weights of more than {WEIGHT_BYTES} bytes cannot be sent to every task")
        shared, p = self.blocks.sparkSession.sparkContext.broadcast(weights), self.p
        drawn = self.blocks
        if share < 1:
            drawn = drawn.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "block"), F.lit(1 << 20)) < int(share * (1 << 20)))

        def partial(batches):
            n, total = 0, None
            for batch in batches:
                for block, packed in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                    x = np.frombuffer(packed).reshape(-1, p)
                    found = f(x, shared.value, block, turn)
                    n, total = n + len(x), found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            if total is not None:
                flat = np.concatenate([[n], *(t.ravel() for t in total)])
                shapes = ";".join(",".join(map(str, t.shape)) for t in total)
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([shapes])], names=["sums", "shapes"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(s) for s in table.column("sums").to_pylist()], axis=0)
            return pa.table({"sums": pa.array([total.tobytes()], pa.binary()), "shapes": table.column("shapes").slice(0, 1)})

        parts = drawn.mapInArrow(partial, "sums binary, shapes string")
        got = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(self.fan)).alias("group")).applyInArrow(add, "sums binary, shapes string").collect()
        shared.unpersist()
        if not got:
            return 0, []
        flat, at, out = np.sum([np.frombuffer(r["sums"]) for r in got], axis=0), 1, []
        for shape in got[0]["shapes"].split(";"):
            dims = tuple(int(d) for d in shape.split(",") if d)
            size = math.prod(dims)
            out.append(flat[at : at + size].reshape(dims))
            at += size
        return round(flat[0]), out


class Adam:
    """Steps scaled by running moments of the gradient."""

    def __init__(self, rate: float, beta: float = 0.9, beta2: float = 0.999):
        self.rate, self.beta, self.beta2, self.first, self.second, self.turn = rate, beta, beta2, None, None, 0

    def step(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> list[np.ndarray]:
        self.turn += 1
        zero = [np.zeros_like(g) for g in gradients]
        self.first = [self.beta * m + (1 - self.beta) * g for m, g in zip(self.first or zero, gradients, strict=True)]
        self.second = [self.beta2 * v + (1 - self.beta2) * g * g for v, g in zip(self.second or zero, gradients, strict=True)]
        grow = math.sqrt(1 - self.beta2**self.turn) / (1 - self.beta**self.turn)
        return [w - self.rate * grow * m / (np.sqrt(v) + 1e-8) for w, m, v in zip(weights, self.first, self.second, strict=True)]


def _gaussian(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
    """Sums over rows of W P z z' P, of the squares of P z, for the precision P of a factor model; nothing of p x p size leaves a task."""
    w, noise, mean = weights
    z = (x - mean) @ woodbury_inverse(w, noise)
    return [(w @ z.T) @ z, np.sum(z * z, axis=0)]


def factor_model_sgd(df: DataFrame, columns: list[str], factors: int, shared_noise: bool = False, rounds: int = 150, rate: float = 0.05, share: float = 1.0, seed: int = 2021) -> FactorModel:
    """Factor analysis, or with shared_noise probabilistic PCA, by stochastic gradients of the Gaussian likelihood: loadings and the logarithm of the noise. The
    rate falls to a tenth along the rounds. ValueError on a table without rows."""
    with Blocks(df, columns) as data:
        n, moments = data.sums(lambda x, *_: [x.sum(axis=0), (x * x).sum(axis=0)], [])
        if not n:
            raise ValueError("no rows to fit on")
        mean = moments[0] / n
        spread = np.maximum(moments[1] / n - mean**2, 1e-9)
        rng = np.random.default_rng(seed)
        w, log_noise = rng.normal(size=(factors, len(columns))) * np.sqrt(spread / (2 * factors)), np.log(spread / 2)
        adam = Adam(rate)
        for turn in range(rounds):
            noise = np.exp(log_noise) if not shared_noise else np.full(len(columns), math.exp(log_noise.mean()))
            m, sums = data.sums(_gaussian, [w, noise, mean], turn, seed, share)
            if not m:
                continue
            precision = woodbury_inverse(w, noise)
            slope = noise / 2 * (np.diag(precision) - sums[1] / m)
            slope = np.full(len(columns), slope.mean()) if shared_noise else slope
            adam.rate = rate * 0.1 ** (turn / rounds)
            w, log_noise = adam.step([w, log_noise], [w @ precision - sums[0] / m, slope])
        noise = np.exp(log_noise) if not shared_noise else np.full(len(columns), math.exp(log_noise.mean()))
    return FactorModel(w, noise, mean)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def reduced_rank_logistic_rows(df: DataFrame, columns: list[str], labels: list[str], l1: float = 0.0, nuclear: float = 0.1, rounds: int = 500, rate: float = 0.5, share: float = 1.0, seed: int = 2021) -> tuple[np.ndarray, np.ndarray]:
    """reduced_rank_logistic() on a table: weights (columns x labels) and biases, equal to it where every round takes all blocks. Proximal steps on the
    driver, one pass over the blocks each; latent.decision() makes the scores columns again."""
    p = len(columns)

    def slopes(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
        err = _sigmoid(x[:, :p] @ weights[0] + weights[1]) - x[:, p:]
        return [x[:, :p].T @ err, err.sum(axis=0)]

    with Blocks(df, [*columns, *labels]) as data:
        n, (gram,) = data.sums(lambda x, *_: [x[:, :p].T @ x[:, :p]], [])
        step = rate * 4 * n / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
        w, b = np.zeros((p, len(labels))), np.zeros(len(labels))
        for turn in range(rounds):
            m, sums = data.sums(slopes, [w, b], turn, seed, share)
            if not m:
                continue
            w, b = w - step * sums[0] / m, b - rate * sums[1] / m
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            u, s, vt = np.linalg.svd(w, full_matrices=False)
            w = (u * np.maximum(s - step * nuclear, 0)) @ vt
    return w, b


def mrf_nce_rows(df: DataFrame, columns: list[str], noise_ratio: int = 5, rounds: int = 400, rate: float = 0.05, l2: float = 1e-3, share: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """mrf_nce() on a table of binary columns: fields, interactions, log partition. Noise rows are drawn with each block, by seed, round and block, so
    they are the same wherever the block is computed and never move."""

    def slopes(x: np.ndarray, weights: list[np.ndarray], block: int, turn: int) -> list[np.ndarray]:
        h, j, z, q = weights
        fake = (np.random.default_rng([seed, turn, block]).random((noise_ratio * len(x), len(q))) < q).astype(float)
        both = np.vstack([x, fake])
        odds = both @ h + 0.5 * np.sum((both @ j) * both, axis=1) - z[0] - both @ np.log(q) - (1 - both) @ np.log(1 - q) - math.log(noise_ratio)
        err = _sigmoid(odds) - np.r_[np.ones(len(x)), np.zeros(len(fake))]
        return [both.T @ err, (both * err[:, None]).T @ both, np.array([err.sum()])]

    with Blocks(df, columns) as data:
        n, (total,) = data.sums(lambda x, *_: [x.sum(axis=0)], [])
        q = np.clip(total / n, 0.01, 0.99)
        h, j, z = np.log(q / (1 - q)), np.zeros((len(q), len(q))), np.array([-np.log(1 - q).sum()])
        for turn in range(rounds):
            m, sums = data.sums(slopes, [h, j, z, q], turn, seed, share)
            if not m:
                continue
            h, z = h - rate * sums[0] / m, z + rate * sums[2] / m
            slope = sums[1] / (2 * m) + l2 * j
            np.fill_diagonal(slope, 0)
            j = j - rate * (slope + slope.T) / 2
    return h, j, float(z[0])


def mrf_scores(df: DataFrame, columns: list[str], h: np.ndarray, j: np.ndarray, name: str = "score") -> DataFrame:
    """df with the unnormalised log probability of each row, in built-in expressions: one product per interaction that isn't 0."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    terms = [x[i] * F.lit(float(h[i])) for i in range(len(x))] + [x[a] * x[b] * F.lit(float(j[a, b] + j[b, a]) / 2) for a in range(len(x)) for b in range(a) if j[a, b] or j[b, a]]
    return df.select("*", sum(terms, F.lit(0.0)).alias(name))
