"""Joins whose hot keys are measured and split, and group means without a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, so at most HOT_SHARE keys are; each is dealt over SALTS partitions.
HOT_SHARE, SALTS = 200, 64
#: A side of fewer bytes, by the planner's estimate, is not measured: no task of it can be long.
SMALL_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(df: DataFrame, keys: list[Column], share: int = HOT_SHARE) -> DataFrame:
    """k0, k1, ... of the keys with more than 1 / share of all rows, null keys included: fewer than share rows, whatever the data. One pass of
    map-side combined counts; the total is a sum over the counts."""
    counts = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > n / share).drop("n")


def split_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", measure: bool | None = None, salts: int = SALTS) -> DataFrame:
    """Join on pairs of a left and a right column, nulls being equal, with left's hot keys split.

    left's rows of a hot key are dealt over salts by a hash of the whole row, right's rows of that key are repeated for each salt; other rows
    have salt 0. So a key with a third of the rows is spread over salts tasks, and only a few keys' rows of the smaller side are repeated. how: inner or left;
    the columns of both sides must have different names. measure: whether hot keys are looked for, by default if left may be larger than SMALL_BYTES.
    """
    if measure is None:
        measure = estimated_bytes(left) > SMALL_BYTES
    same = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in on]
    if not measure:
        return left.join(right, same, how)
    hot = hot_keys(left, [F.col(f"`{a}`") for a, _ in on]).withColumn("__hot", F.lit(True))

    def marked(df: DataFrame, side: int) -> DataFrame:
        is_key = [F.col(f"`{pair[side]}`").eqNullSafe(F.col(f"k{i}")) for i, pair in enumerate(on)]
        return df.join(F.broadcast(hot), is_key, "left")

    drop = ["__hot", *(f"k{i}" for i in range(len(on)))]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")).otherwise(0)
    dealt = marked(left, 0).withColumn("__salt", salt).drop(*drop)
    every = F.sequence(F.lit(0), F.when(F.col("__hot"), salts - 1).otherwise(0))
    repeated = marked(right, 1).withColumn("__copy", F.explode(every)).drop(*drop)
    return dealt.join(repeated, [*same, F.col("__salt") == F.col("__copy")], how).drop("__salt", "__copy")


def with_group_means(df: DataFrame, group: str, columns: list[str], suffix: str = "_mean", measure: bool | None = None) -> DataFrame:
    """df with the mean of each column over the rows of its group, null being a group of its own: partial sums in each task, one row per group, joined back
    with hot groups split. No group comes together in one task."""
    means = df.groupBy(F.col(f"`{group}`").alias("__group")).agg(*[F.avg(F.col(f"`{c}`")).alias(f"__m{k}") for k, c in enumerate(columns)])
    out = split_join(df, means, [(group, "__group")], "left", measure)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__m{k}").alias(f"{c}{suffix}") for k, c in enumerate(columns)])
