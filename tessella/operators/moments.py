"""Moments of numeric columns: unrolled sums for few columns, partial Gram matrices by Arrow batches for many."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Row count, column means and sum of centred outer products (scatter) of a matrix; all that the p x p statistics need of it.

    Parts are centred by their own means and merged by the difference of means, so columns far from zero lose no digits.
    """

    n: int
    mean: np.ndarray
    centred: np.ndarray

    @property
    def p(self) -> int:
        return len(self.mean)

    @property
    def total(self) -> np.ndarray:
        return self.mean * self.n

    @property
    def gram(self) -> np.ndarray:
        """Sum of outer products, not centred."""
        return self.centred + self.n * np.outer(self.mean, self.mean)

    def scatter(self) -> np.ndarray:
        return self.centred

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.centred / (self.n - ddof)

    def about_zero(self) -> Moments:
        """Of the centred matrix."""
        return Moments(self.n, np.zeros(self.p), self.centred)

    def __add__(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.centred + other.centred + np.outer(gap, gap) * (self.n * other.n / n))


def of_matrix(x: np.ndarray) -> Moments:
    x = np.asarray(x, dtype=float)
    w = x - x.mean(axis=0)
    return Moments(len(x), x.mean(axis=0), w.T @ w)


def moments(df: DataFrame, columns: list[str], group: str | None = None) -> dict:
    """Moments of numeric columns, per value of group (None: key None). Rows with a missing value in any column are left out.

    Each partition merges one scatter matrix per group; its rows are merged across partitions by tasks of their own, so that is spread over
    p tasks and the driver gets one p x p matrix per group.
    """
    p = len(columns)
    key = F.col(group).cast("string") if group else F.lit("")
    rows = df.select(key.alias("g"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)])

    def partial(batches):
        sums: dict[str, Moments] = {}
        for batch in batches:
            x = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(p)]) if batch.num_rows else np.zeros((0, p))
            keep = ~np.isnan(x).any(axis=1)
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            for g in set(keys[keep].tolist()):
                part = of_matrix(x[keep & (keys == g)])
                sums[g] = sums[g] + part if g in sums else part
        g = [k for k in sums for _ in range(p)]
        packed = [np.concatenate([[m.n], m.mean, row]).tobytes() for m in sums.values() for row in m.centred]
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array([i for _ in sums for i in range(p)], pa.int32()), pa.array(packed, pa.binary())], names=["g", "i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, row, g, i = 0.0, np.zeros(p), np.zeros(p), None, 0
        for batch in batches:
            g, i = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            for packed in batch.column(2).to_pylist():
                x = np.frombuffer(packed)
                m, gap = x[0], x[1 : p + 1] - mean
                row = row + x[p + 1 :] + gap[i] * gap * (n * m / (n + m))
                mean, n = mean + gap * (m / (n + m)), n + m
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([i], pa.int32()), pa.array([np.concatenate([[n], mean, row]).tobytes()], pa.binary())], names=["g", "i", "row"])

    schema = "g string, i int, row binary"
    got = rows.mapInArrow(partial, schema).groupBy("g", "i").applyInArrow(add, schema).toPandas()
    out = {}
    for g, part in got.groupby("g", dropna=False):
        centred, head = np.zeros((p, p)), np.zeros(p + 1)
        for i, packed in zip(part["i"], part["row"], strict=True):
            x = np.frombuffer(packed)
            head, centred[i] = x[: p + 1], x[p + 1 :]
        out[g if group else None] = Moments(round(head[0]), head[1:].copy(), (centred + centred.T) / 2)
    return out


def covariance_entries(df: DataFrame, columns: list[str], group: list[str] = ()) -> DataFrame:
    """Long i, j, n, c (i <= j) of up to 20 or so columns in one map-side combined aggregation, per group: covariances with divisor n, by
    the JVM's merging of centred parts."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(f"`{x}`").cast("double") for x in columns]
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.covar_pop(c[i], c[j]).alias(f"p{i}_{j}") for i, j in pairs])
    return sums.select(*group, "n", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("c")) for i, j in pairs])))


def product_sums(df: DataFrame, columns: list[str], group: list[str] = ()) -> DataFrame:
    """Long i, j, n, si, sj, sij (i <= j) of up to 20 or so columns in one map-side combined aggregation, per group."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(f"`{x}`") for x in columns]
    sums = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs])
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}").alias("si"), F.col(f"s{j}").alias("sj"), F.col(f"p{i}_{j}").alias("sij")) for i, j in pairs]
    return sums.select(*group, "n", F.inline(F.array(*entries)))


def mirrored(upper: DataFrame) -> DataFrame:
    """Both triangles of a symmetric long matrix from its upper one (columns i, j and others)."""
    rest = [c for c in upper.columns if c not in ("i", "j")]
    return upper.select(F.col("*"), F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("__t")).select(
        F.when(F.col("__t"), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("__t"), F.col("i")).otherwise(F.col("j")).alias("j"), *rest
    )
