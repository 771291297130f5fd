"""Parent-of-origin effects: callers by whitened covariance, and the POIROT omnibus test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.functions.special import f_sf, normal_cdf, normal_quantile
from tessella.operators import hypothesis, matrices
from tessella.operators.covariance import ESTIMATORS
from tessella.operators.moments import Moments, moments, of_matrix
from tessella.operators.replicates import broadcast_samples, replicate, replicate_vectors
from tessella.operators.skew import split_join, with_group_means

LEAST = 30


def effect_of(homo: Moments, het: Moments, method: str | None = None, loss: str | None = None) -> np.ndarray:
    """Phenotype effect of the transmitting parent: heterozygotes whitened by the homozygotes' covariance stick out along it."""
    root = np.linalg.cholesky(ESTIMATORS[method](homo.about_zero()) if method else homo.covariance())
    half = np.linalg.solve(root, het.covariance())
    values, vectors = np.linalg.eigh(np.linalg.solve(root, half.T))
    top = values[::-1]
    if loss:
        top, _ = matrices.optimal_shrinkage(top, homo.p / het.n, loss)
    return 2 * math.sqrt(max(top[0] - 1, 0)) * vectors[:, -1] @ root.T


def _enough(counts: dict[int, int]) -> None:
    if min(counts.get(0, 0), counts.get(1, 0)) < LEAST:
        raise ValueError(f"at least {LEAST} samples of genotypes 0 and 1 are needed")


P_VALUES = {
    "rmt4ds": lambda het, homo: hypothesis.lrt_two_sample(het, homo)["p_value"],
    "srivastavayanagihara": lambda het, homo: hypothesis.srivastava_yanagihara([het, homo])[1],
    "srivastava": lambda het, homo: hypothesis.srivastava_2007([het, homo])[1],
}


def single_variant(df: DataFrame, genotype: str, phenotypes: list[str], alternative: bool = True, method: str = "Empirical", loss: str | None = None, p_value: str = "rmt4ds", check: bool = True) -> dict:
    """Effect and p-value of one variant; genotypes other than 0, 1, 2 are left out. One distributed pass gives the moments per genotype.

    The homozygotes of reference are those of genotype 2 if allowed and more than those of 0. If heterozygotes vary less than
    homozygotes in every phenotype, or a homozygote variance is 0, the model doesn't fit: effect 0, p 1.
    """
    found = {int(float(k)): m for k, m in moments(df.where(F.col(genotype).isin(0, 1, 2)), phenotypes, genotype).items()}
    return _one_variant(found, len(phenotypes), alternative, method, loss, p_value, check)


def _one_variant(found: dict[int, Moments], p: int, alternative: bool, method: str, loss: str | None, p_value: str, check: bool) -> dict:
    _enough({k: m.n for k, m in found.items()})
    reference = 2 if alternative and 2 in found and found[2].n > found[0].n else 0
    homo, het = found[reference], found[1]
    a, b = np.diag(homo.covariance(0)), np.diag(het.covariance(0))
    if check and (np.all(b < a) or np.any(a == 0)):
        return {"effect": np.zeros(p), "p_value": 1.0, "reference": reference}
    return {"effect": effect_of(homo, het, method, loss), "p_value": P_VALUES[p_value](het, homo), "reference": reference}


def permutation_p(spark: SparkSession, x: np.ndarray, y: np.ndarray, reference: int = 0, permutations: int = 10_000, seed: int = 2021) -> float:
    """Share of label permutations of centred phenotypes with an effect longer than the observed one. The two genotypes' samples, matrices that
    fit a task, are broadcast; permutations are dealt over tasks."""
    a, b = x[y == reference], x[y == 1]
    length, n = np.linalg.norm(effect_of(of_matrix(a), of_matrix(b))), len(b)
    shared = broadcast_samples(spark, np.vstack([a - a.mean(axis=0), b - b.mean(axis=0)]))

    def one(k: int) -> float:
        (both,) = shared.value
        order = np.random.default_rng([seed, k]).permutation(len(both))
        return float(np.linalg.norm(effect_of(of_matrix(both[order[n:]]), of_matrix(both[order[:n]]))) > length)

    return float(replicate(spark, permutations, one).agg(F.avg("value")).first()[0])


def bootstrap_interval(spark: SparkSession, x: np.ndarray, y: np.ndarray, reference: int = 0, replicates: int = 10_000, alpha: float = 0.05, seed: int = 2021) -> np.ndarray:
    """Bias-corrected and accelerated percentile interval of each component of the effect, heterozygotes resampled. Replicates are dealt over
    tasks; the driver gets one effect of each."""
    homo = of_matrix(x[y == reference])
    effect = effect_of(homo, of_matrix(x[y == 1]))
    shared = broadcast_samples(spark, x[y == 1])

    def one(k: int) -> np.ndarray:
        (het,) = shared.value
        draw = effect_of(homo, of_matrix(het[np.random.default_rng([seed, k]).integers(len(het), size=len(het))]))
        return draw if draw @ effect > 0 else -draw

    draws = np.array([r["value"] for r in replicate_vectors(spark, replicates, one).orderBy("replicate").collect()])
    return np.array([bca(own, e, alpha) for own, e in zip(draws.T, effect, strict=True)])


def bca(draws: np.ndarray, estimate: float, alpha: float) -> tuple[float, float]:
    """Bias-corrected and accelerated percentile interval of one number."""
    n = len(draws)
    z0 = normal_quantile(min(max(float(np.mean(draws < estimate)), 0.5 / n), 1 - 0.5 / n))
    gap = (draws - draws.mean()) / (n - 1)
    skew = float(np.sum(gap**3) / (6 * max(np.sum(gap**2), 1e-300) ** 1.5))
    at = [z0 + normal_quantile(q) for q in (alpha / 2, 1 - alpha / 2)]
    return tuple(float(np.percentile(draws, 100 * normal_cdf(z0 + z / (1 - skew * z)))) for z in at)


def genotype_moments(df: DataFrame, variant: str, genotype: str, phenotypes: list[str], kinds: tuple[int, ...]) -> DataFrame:
    """One row per variant, and per genotype k of kinds the columns n_k, mean_k and cov_k (upper triangle, divisor n), from one map-side
    combined aggregation; a variant's rows never come together, and parts are merged centred."""
    x = [F.col(f"`{c}`").cast("double") for c in phenotypes]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    columns = []
    for k in kinds:
        own = [F.when(F.col(genotype) == k, c) for c in x]
        columns += [F.count(F.when(F.col(genotype) == k, 1)).alias(f"n_{k}"), F.array(*[F.avg(c) for c in own]).alias(f"mean_{k}"), F.array(*[F.covar_pop(own[i], own[j]) for i, j in pairs]).alias(f"cov_{k}")]
    return df.groupBy(variant).agg(*columns)


def _by_variant(df: DataFrame, variant: str, genotype: str, phenotypes: list[str], kinds: tuple[int, ...], schema: str, call) -> DataFrame:
    """call(moments by genotype) for each variant, as columns of schema; small matrices, thousands of variants to a batch."""
    p = len(phenotypes)
    upper = np.triu_indices(p)
    table = genotype_moments(df, variant, genotype, phenotypes, kinds)
    names = [variant, *(c.split()[0] for c in schema.split(", "))]
    full = StructType.fromDDL(f"`{variant}` {dict(df.dtypes)[variant]}, {schema}")
    arrow = to_arrow_schema(full)

    def run(batches):
        for batch in batches:
            column = {name: batch.column(name).to_pylist() for name in batch.schema.names[1:]}
            rows = []
            for r in range(batch.num_rows):
                found = {}
                for k in kinds:
                    if n := column[f"n_{k}"][r]:
                        c = np.zeros((p, p))
                        c[upper] = column[f"cov_{k}"][r]
                        found[k] = Moments(n, np.array(column[f"mean_{k}"][r]), (c + c.T - np.diag(np.diag(c))) * n)
                rows.append(call(found))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, arrow.field(k + 1).type) for k, v in enumerate(columns))], names=names)

    return table.mapInArrow(run, full)


def many_variants(df: DataFrame, variant: str, genotype: str, phenotypes: list[str], p_value: str = "rmt4ds") -> DataFrame:
    """variant, n_homozygotes, n_heterozygotes, effect, p_value from rows of one sample and variant each; variants run in parallel.

    Variants with too few samples of genotype 0 or 1 get a null effect.
    """

    def call(found: dict[int, Moments]) -> tuple:
        sizes = [found[k].n if k in found else 0 for k in (0, 1)]
        if min(sizes) < LEAST:
            return *sizes, None, None
        return *sizes, effect_of(found[0], found[1]).tolist(), float(P_VALUES[p_value](found[1], found[0]))

    return _by_variant(df, variant, genotype, phenotypes, (0, 1), "n_homozygotes long, n_heterozygotes long, effect array<double>, p_value double", call)


def single_variants(df: DataFrame, variant: str, genotype: str, phenotypes: list[str], alternative: bool = True, method: str = "Empirical", loss: str | None = None, p_value: str = "rmt4ds", check: bool = True) -> DataFrame:
    """variant, reference, effect, p_value: single_variant() of each variant, in parallel, with its choice of the homozygotes of reference and its
    checks of variances. Variants with too few samples of genotype 0 or 1 get nulls."""

    def call(found: dict[int, Moments]) -> tuple:
        try:
            out = _one_variant(found, len(phenotypes), alternative, method, loss, p_value, check)
        except ValueError:
            return None, None, None
        return out["reference"], np.asarray(out["effect"]).tolist(), float(out["p_value"])

    return _by_variant(df, variant, genotype, phenotypes, (0, 1, 2), "reference int, effect array<double>, p_value double", call)


def resampled_variants(df: DataFrame, variant: str, genotype: str, phenotypes: list[str], permutations: int = 1000, replicates: int = 1000, alpha: float = 0.05, seed: int = 2021) -> DataFrame:
    """variant, permutation_p, low, high: permutation p-value and BCa interval per variant against genotype 0. The rows of a variant, one per
    sample, are one task's: a resample needs them together. Variants with too few samples get nulls."""
    kind = dict(df.dtypes)[variant]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[phenotypes].to_numpy(dtype=float), pdf[genotype].to_numpy()
        a, b = x[y == 0], x[y == 1]
        row = {variant: [pdf[variant].iloc[0]], "permutation_p": [None], "low": [None], "high": [None]}
        if min(len(a), len(b)) >= LEAST:
            rng, homo = np.random.default_rng(seed), of_matrix(a)
            effect = effect_of(homo, of_matrix(b))
            both, above = np.vstack([a - a.mean(axis=0), b - b.mean(axis=0)]), 0
            for _ in range(permutations):
                order = rng.permutation(len(both))
                above += np.linalg.norm(effect_of(of_matrix(both[order[len(b) :]]), of_matrix(both[order[: len(b)]]))) > np.linalg.norm(effect)
            draws = np.array([effect_of(homo, of_matrix(b[rng.integers(len(b), size=len(b))])) for _ in range(replicates)])
            draws *= np.where(draws @ effect > 0, 1, -1)[:, None]
            ends = [bca(own, e, alpha) for own, e in zip(draws.T, effect, strict=True)]
            row |= {"permutation_p": [above / permutations], "low": [[e[0] for e in ends]], "high": [[e[1] for e in ends]]}
        return pd.DataFrame(row)

    rows = df.where(F.col(genotype).isin(0, 1)).select(variant, genotype, *[F.col(f"`{c}`") for c in phenotypes])
    return rows.groupBy(variant).applyInPandas(run, f"`{variant}` {kind}, permutation_p double, low array<double>, high array<double>")


def call_parent(phenotypes: list[str], means: np.ndarray, effect: np.ndarray) -> Column:
    """Whether a row lies on the effect's side of the mean."""
    return sum(((F.col(f"`{c}`") - F.lit(float(m))) * F.lit(float(e)) for c, m, e in zip(phenotypes, means, effect, strict=True)), F.lit(0.0)) > 0


def group_means(df: DataFrame, group: str, columns: list[str], suffix: str = "_mean") -> DataFrame:
    """df with the group's mean of each column."""
    return with_group_means(df, group, columns, suffix)


def centre_by_group(df: DataFrame, group: str, columns: list[str], mode: str = "median", suffix: str = "_centred") -> DataFrame:
    """df with residuals from the group's median or mean, or the values themselves (none). Centres are one small aggregate, joined back."""
    if mode == "none":
        return df.select("*", *[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in columns])
    if mode not in ("mean", "median"):
        raise ValueError(f"no centring {mode!r}")
    f = F.avg if mode == "mean" else F.median
    centres = df.groupBy(F.col(group).alias("__g")).agg(*[f(F.col(f"`{c}`")).alias(f"__c{k}") for k, c in enumerate(columns)])
    out = split_join(df, centres, [(group, "__g")], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"`{c}`") - F.col(f"__c{k}")).alias(f"{c}{suffix}") for k, c in enumerate(columns)])


def covariate_residuals(x: np.ndarray, covariates: np.ndarray) -> np.ndarray:
    """Residuals of least squares on covariates and an intercept."""
    design = np.column_stack([np.ones(len(x)), covariates])
    return x - design @ np.linalg.lstsq(design, x, rcond=None)[0]


def poirot(x: np.ndarray, genotype: np.ndarray) -> tuple[float, float]:
    """R-omnibus statistic and p: products of median-centred phenotypes, signed square roots, heterozygotes against homozygotes."""
    z = x.astype(float).copy()
    for g in np.unique(genotype):
        z[genotype == g] -= np.median(z[genotype == g], axis=0)
    i, j = np.triu_indices(x.shape[1])
    w = z[:, i] * z[:, j]
    w = np.divide(w, np.sqrt(np.abs(w)), out=np.zeros_like(w), where=w != 0)
    het = ~np.isin(genotype, (0, 2))
    return hypothesis.hotelling(of_matrix(w[het]), of_matrix(w[~het]))


def poirot_variants(df: DataFrame, variant: str, genotype: str, phenotypes: list[str]) -> DataFrame:
    """variant, statistic, p_value of the omnibus test per variant; the rows of a variant, one per sample, are one task's."""
    kind = dict(df.dtypes)[variant]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, p = poirot(pdf[phenotypes].to_numpy(dtype=float), pdf[genotype].to_numpy())
        return pd.DataFrame({variant: [pdf[variant].iloc[0]], "statistic": [stat], "p_value": [p]})

    return df.select(variant, genotype, *[F.col(f"`{c}`") for c in phenotypes]).groupBy(variant).applyInPandas(run, f"`{variant}` {kind}, statistic double, p_value double")


def wilks_p(lam: float, q: int, n: int) -> float:
    """p of Wilks' lambda for two groups."""
    return f_sf((1 - lam) / lam * (n - q - 1) / q, q, n - q - 1)
