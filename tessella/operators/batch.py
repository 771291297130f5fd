"""Batch correction: means, rotations, and shrunken controls."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import covariance, matrices
from tessella.operators.hamiltonian import batch_posterior
from tessella.operators.moments import moments


def mean_adaptation(wide: DataFrame, batch: str, columns: list[str], regularisation: float = 0.0, weighted: bool = False) -> DataFrame:
    """x - batch mean + (1 - regularisation) * centre, the mean of batch means (weighted: by rows). Means are one small aggregate
    per batch, joined back."""
    means = wide.groupBy(batch).agg(F.count("*").alias("__n"), *[F.avg(F.col(f"`{c}`")).alias(f"__m{k}") for k, c in enumerate(columns)])
    weight = F.col("__n") if weighted else F.lit(1.0)
    centre = means.agg(*[(F.sum(weight * F.col(f"__m{k}")) / F.sum(weight) * (1 - regularisation)).alias(f"__c{k}") for k in range(len(columns))])
    both = means.crossJoin(F.broadcast(centre)).select(F.col(batch).alias("__b"), *[(F.col(f"__c{k}") - F.col(f"__m{k}")).alias(f"__d{k}") for k in range(len(columns))])
    out = wide.join(both, F.col(batch).eqNullSafe(F.col("__b")), "left")
    return out.select(*[(F.col(f"`{c}`") + F.col(f"__d{columns.index(c)}")).alias(c) if c in columns else F.col(f"`{c}`") for c in wide.columns])


CENTROIDS = {"logeuclid": matrices.log_euclidean_mean, "harmonic": matrices.harmonic_mean, "karcher": matrices.karcher_mean}


def rotation_maps(wide: DataFrame, batch: str, columns: list[str], method: str = "Empirical", centroid: str = "logeuclid", ridge: float = 1e-3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per batch its offset and matrix: x -> (x - offset) @ matrix + mean of means is in the offsets' target. Covariances are of centred
    columns; one distributed pass gives the moments of all batches."""
    found = moments(wide, columns, batch)
    centred = {b: m.about_zero() for b, m in found.items()}
    sigmas = {b: covariance.ESTIMATORS[method](m) + ridge * np.eye(m.p) for b, m in centred.items()}
    target = np.linalg.cholesky(CENTROIDS[centroid](list(sigmas.values())))
    middle = np.mean([m.mean for m in found.values()], axis=0)
    out = {}
    for b, m in found.items():
        root = np.linalg.cholesky(sigmas[b])
        turn = np.linalg.solve(root.T, target.T)
        out[b] = (middle - m.mean @ turn, turn)
    return out


def rotation_adaptation(wide: DataFrame, batch: str, columns: list[str], **options) -> DataFrame:
    """Each batch whitened by its own covariance, coloured by the batches' centroid, and moved to the mean of means.

    Maps go out as one row per batch of p offsets and p * p coefficients; a row's new values are JVM-side dot products.
    """
    maps = rotation_maps(wide, batch, columns, **options)
    p = len(columns)
    table = wide.sparkSession.createDataFrame([(b, o.tolist(), t.T.tolist()) for b, (o, t) in maps.items()], "__b string, __o array<double>, __t array<array<double>>")
    out = wide.join(table, F.col(batch).cast("string").eqNullSafe(F.col("__b")), "left")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    dot = lambda k: F.aggregate(F.zip_with(x, F.col("__t")[k], lambda a, b: a * b), F.col("__o")[k], lambda s, v: s + v)
    new = {c: dot(k).alias(c) for k, c in enumerate(columns)}
    assert len(new) == p
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in wide.columns])


def constrained_least_squares(a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """min |ax - b| with every x >= floor, by trying every set of active bounds (of three variables: eight)."""
    best, value = None, np.inf
    n = a.shape[1]
    for mask in range(1 << n):
        free = [k for k in range(n) if not mask >> k & 1]
        x = np.full(n, float(floor))
        if free:
            x[free] = np.linalg.lstsq(a[:, free], b - a @ np.where(np.isin(range(n), free), 0.0, floor), rcond=None)[0]
        if (x >= floor - 1e-12).all() and (loss := np.linalg.norm(a @ x - b)) < value - 1e-15:
            best, value = x, loss
    return best


#: Rows of a batch that one task numbers.
CELL_ROWS = 50_000

#: Split R-hat above which chains count as not mixed.
R_HAT = 1.05


def one_value_per_batch(values: DataFrame, resamples: int, seed: int = 0) -> DataFrame:
    """replicate, batch, x: in each replicate one uniformly drawn value of each batch.

    Values are numbered in cells of about CELL_ROWS by a hash, and a draw looks up its place by the cells' counts, so no batch's values
    come together. There are as many draws as replicates times batches.
    """
    n = values.count()
    cells = max(1, -(-n // CELL_ROWS))
    dealt = values.withColumn("__cell", F.pmod(F.xxhash64(*values.columns), F.lit(cells)).cast("int"))
    numbered = dealt.select("batch", "x", "__cell").withColumn("__at", F.row_number().over(Window.partitionBy("batch", "__cell").orderBy("x")) - 1)
    w = Window.partitionBy("batch")
    upto = F.sum("__n").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    counts = numbered.groupBy("batch", "__cell").agg(F.count("*").alias("__n")).select("batch", "__cell", "__n", (upto - F.col("__n")).alias("__first"), F.sum("__n").over(w).alias("__all"))
    draws = counts.select("batch", "__all").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.withColumn("__place", F.pmod(F.xxhash64(F.lit(seed), "batch", "replicate"), F.col("__all")))
    # The cell of a draw is the last one that begins at or before its place: draws and cells of a batch in one order, no pairs of them.
    both = draws.select("batch", "replicate", "__place", F.lit(None).cast("int").alias("__c"), F.lit(None).cast("long").alias("__f"))
    both = both.unionByName(counts.select("batch", F.lit(-1).alias("replicate"), F.col("__first").alias("__place"), F.col("__cell").alias("__c"), F.col("__first").alias("__f")))
    upto = w.orderBy("__place", "replicate").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.select("batch", "replicate", "__place", F.last("__c", ignorenulls=True).over(upto).alias("__cell"), F.last("__f", ignorenulls=True).over(upto).alias("__begin"))
    found = placed.where("replicate >= 0").select("replicate", "batch", "__cell", (F.col("__place") - F.col("__begin")).alias("__at"))
    return found.join(numbered, ["batch", "__cell", "__at"]).select("replicate", "batch", "x")


def univariate_weight(values: DataFrame, controls: DataFrame, resamples: int = 1000, floor: float = 1e-6, seed: int = 0) -> tuple[float, float]:
    """Weight of a batch's control and the mean control, from values (batch, x) and controls (batch, control), one per batch.

    Three variances (divisor n + 1) fix error, batch and sample variance by bounded least squares: of one value per batch (the
    median over seeded resamples), of controls, and of values less their batch's mean. All are aggregates; the driver gets numbers only.
    """
    c = controls.agg(F.count("*"), F.avg("control"), F.var_pop("control")).first()
    per = values.groupBy("batch").agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    inner = per.agg(F.sum("n"), F.sum(F.col("n") * F.col("v")) / F.sum("n")).first()
    spread = one_value_per_batch(values, resamples, seed).groupBy("replicate").agg((F.var_pop("x") * F.count("*") / (F.count("*") + 1)).alias("v"))
    across = spread.agg(F.median("v")).first()[0]
    shrunk = lambda var, n: var * n / (n + 1)
    a = np.array([[1.0, 1, 1], [1, 1, 0], [1, 0, 1]])
    error, theta, _ = constrained_least_squares(a, np.array([across, shrunk(c[2], c[0]), shrunk(inner[1], inner[0])]), floor)
    return float(np.clip(theta / (error + theta), 0, 1)), float(c[1])


def univariate_adaptation(values: DataFrame, controls: DataFrame, **options) -> DataFrame:
    """values with x less weight * (control of the batch - mean control)."""
    weight, centre = univariate_weight(values, controls, **options)
    return values.join(controls, "batch").withColumn("x", F.col("x") - F.lit(weight) * (F.col("control") - F.lit(centre))).drop("control")


def bayesian_adaptation(values: DataFrame, controls: DataFrame, samples: int = 2000, burn_in: int = 500, seed: int = 0, sampler: str = "gibbs") -> DataFrame:
    """Univariate adaptation with the weight averaged over draws of the batch and error variances given the controls' spread.

    controls: batch, control, replicate (several per batch). Both samplers run on three numbers per batch: "gibbs" on the driver, "nuts" as four chains in
    tasks, each of samples draws, with a warning where their split R-hat is above R_HAT.
    """
    if sampler not in ("gibbs", "nuts"):
        raise ValueError(f"no sampler {sampler!r}")
    table = controls.groupBy("batch").agg(F.avg("control").alias("m"), F.count("*").alias("n"), F.var_pop("control").alias("v")).orderBy("batch").toPandas()
    m, n, v = (table[c].to_numpy(dtype=float) for c in "mnv")
    weights = _gibbs_weights(m, n, v, samples, burn_in, seed) if sampler == "gibbs" else _chain_weights(values.sparkSession, m, n, v, samples, burn_in, seed)
    spark = values.sparkSession
    shift = spark.createDataFrame([(b, float(w * (x - m.mean()))) for b, w, x in zip(table["batch"].tolist(), weights, m, strict=True)], f"batch {dict(controls.dtypes)['batch']}, shift double")
    return values.join(shift, "batch").withColumn("x", F.col("x") - F.col("shift")).drop("shift")


def _chain_weights(spark: SparkSession, m: np.ndarray, n: np.ndarray, v: np.ndarray, samples: int, burn_in: int, seed: int) -> np.ndarray:
    weights, r_hat = batch_posterior(spark, m, n, v, samples=samples, warmup=burn_in, seed=seed)
    if r_hat.max() > R_HAT:
        warnings.warn(f"the chains have not mixed: split R-hat {r_hat.max():.3f}", stacklevel=3)
    return weights


def _gibbs_weights(m: np.ndarray, n: np.ndarray, v: np.ndarray, samples: int, burn_in: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    mu, theta, error = m.mean(), max(m.var(), 1e-6), max(v.mean(), 1e-6)
    weights = np.zeros(len(m))
    for k in range(samples + burn_in):
        precision = n / error + 1 / theta
        b = rng.normal((n * m / error + mu / theta) / precision, 1 / np.sqrt(precision))
        mu = rng.normal(b.mean(), np.sqrt(theta / len(b)))
        theta = 1 / rng.gamma(1 + len(b) / 2, 1 / (1e-3 + np.sum((b - mu) ** 2) / 2))
        error = 1 / rng.gamma(1 + n.sum() / 2, 1 / (1e-3 + np.sum(n * v + n * (m - b) ** 2) / 2))
        if k >= burn_in:
            weights += theta / (theta + error / n) / samples
    return weights
