"""Replicates of a resampling scheme as Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of sample matrices that may be broadcast to the tasks; resampling needs whole samples in each.
SAMPLE_BYTES = 512 << 20


def broadcast_samples(spark: SparkSession, *samples: np.ndarray) -> Broadcast:
    """Matrices for the tasks; raises ValueError if they are larger than SAMPLE_BYTES together."""
    size = sum(np.asarray(x).nbytes for x in samples)
    if size > SAMPLE_BYTES:
        raise ValueError(f"samples of {size} bytes are too large to resample in every task ({SAMPLE_BYTES} at most)")
    return spark.sparkContext.broadcast(samples)


def replicate(spark: SparkSession, n: int, f: Callable[[int], float | None], parts: int | None = None) -> DataFrame:
    """replicate, value: f(seed) for n seeds, dealt over tasks."""
    parts = parts or min(n, spark.sparkContext.defaultParallelism)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"replicate": pdf["id"], "value": [f(int(i)) for i in pdf["id"]]}).astype({"value": "float64"})

    return spark.range(0, n, 1, parts).mapInPandas(run, "replicate long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def replicate_vectors(spark: SparkSession, n: int, f: Callable[[int], np.ndarray], parts: int | None = None) -> DataFrame:
    """replicate, value (an array): f(seed) for n seeds, dealt over tasks."""
    parts = parts or min(n, spark.sparkContext.defaultParallelism)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"replicate": pdf["id"], "value": [np.asarray(f(int(i)), dtype=float).tolist() for i in pdf["id"]]})

    return spark.range(0, n, 1, parts).mapInPandas(run, "replicate long, value array<double>")
