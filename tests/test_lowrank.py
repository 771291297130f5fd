import numpy as np
import pandas as pd
import pytest

from tessella.operators import imputation, latent
from tessella.operators import lowrank as lr


def table(spark, x, names):
    rows = [(f"r{k:05d}", *(None if np.isnan(v) else float(v) for v in row)) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"`{c}` double" for c in names)).repartition(3)


def holes(seed, n=300, p=6, rank=2, noise=0.05, share=0.2):
    rng = np.random.default_rng(seed)
    full = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, p)) + noise * rng.normal(size=(n, p))
    x = np.where(rng.random((n, p)) < share, np.nan, full)
    x[3] = np.nan
    return full, x


def filled(df, names):
    return df.toPandas().sort_values("id")[names].to_numpy(dtype=float)


@pytest.mark.parametrize("shrinkage", [3.0, 8.0])
def test_completion_equals_that_of_a_matrix_in_memory(spark, shrinkage):
    names = ["a", "b.c", "d", "e", "f", "g"]
    full, x = holes(1)
    df = table(spark, x, names)
    got = filled(lr.fill_low_rank(df, names, lr.soft_impute_rows(df, names, shrinkage, 6, rounds=60, tolerance=1e-6), shrinkage), names)
    want = imputation.soft_impute(x, shrinkage, iterations=3000, tolerance=1e-8)
    assert np.allclose(got, want, atol=0.01) and np.allclose(got[~np.isnan(x)], x[~np.isnan(x)]) and not got[3].any()


def test_least_nuclear_norm_recovers_a_low_rank_matrix(spark):
    names = list("abcdef")
    full, x = holes(2, rank=1, noise=0.0)
    df = table(spark, x, names)
    got = filled(lr.fill_low_rank(df, names, lr.nuclear_norm_rows(df, names, 3), 1e-3), names)
    rows = np.arange(len(x)) != 3
    enough = rows & ((~np.isnan(x)).sum(axis=1) >= 3)
    assert np.abs(got[enough] - full[enough]).max() < 0.05
    assert np.abs(got[enough] - imputation.nuclear_norm(x)[enough]).max() < 0.05


def test_cross_validation_scores_held_out_cells_only(spark):
    names = list("abcdef")
    full, x = holes(3, noise=0.5)
    df = table(spark, x, names)
    loadings, best, scores = lr.soft_impute_cv_rows(df, "id", names, 4, strengths=5, folds=2, held_out=0.2, rounds=15)
    assert scores.shape == (5, 2) and best == np.logspace(-2, 2, 5)[np.argmax(scores.mean(axis=1))] and scores.max() > 0.2
    bits = df.select("id", *[b.alias(c) for b, c in zip(lr.held_out_folds(df, "id", names, 2, 0.2, 2021), names)]).toPandas().sort_values("id")[names].to_numpy()
    assert abs((bits & 1).mean() - 0.2) < 0.04 and abs((bits >> 1).mean() - 0.2) < 0.04
    # scores of one pair, by hand
    cells = np.where(bits & 1, np.nan, x)
    held = np.isnan(cells) & ~np.isnan(x)
    guess = imputation.soft_impute(cells, 10.0, iterations=2000, tolerance=1e-8)[held]
    want = 1 - np.mean((x[held] - guess) ** 2) / np.var(x[held])
    assert abs(scores[3, 0] - want) < 0.03


def test_missing_rows_follow_patterns(spark):
    names = list("abcdef")
    full, x = holes(4, n=1500, noise=0.6)
    df = table(spark, x + 2, names)
    got = lr.ppca_missing_rows(df, names, 2, rounds=100, tolerance=1e-4)
    want = latent.ppca_missing(df, names, 2)
    a, b = got.covariance().matrix, want.covariance().matrix
    assert np.abs(a - b).max() / np.abs(b).max() < 0.02 and np.allclose(got.mean, want.mean) and abs(got.noise[0] - want.noise[0]) < 0.02


def test_other_columns_empty_tables_and_bounds(spark, monkeypatch):
    df = spark.createDataFrame([("p", 1, 1.0, None), ("q", 2, float("nan"), 2.0), ("r", None, None, None)], "x0 string, f0 int, a double, b double")
    out = lr.fill_low_rank(df, ["b", "a"], np.ones((2, 1)), 1.0, mean=np.array([1.0, 0.5]))
    assert out.columns == df.columns and [tuple(r) for r in out.orderBy("x0").collect()] == [("p", 1, 1.0, 1.25), ("q", 2, 1.0, 2.0), ("r", None, 0.5, 1.0)]
    assert lr.fill_low_rank(df.limit(0), ["a"], np.ones((1, 1)), 1.0).count() == 0
    assert lr.soft_impute_rows(df.limit(0), ["a", "b"], 1.0, 1, start=np.ones((2, 1))).tolist() == [[1.0], [1.0]]
    assert lr.nuclear_norm_rows(df.limit(0), ["a", "b"], 1).shape == (2, 1)
    with pytest.raises(ValueError, match="observed"):
        lr.ppca_missing_rows(df.where("x0 = 'r'"), ["a", "b"], 1)
    monkeypatch.setattr(lr, "WEIGHT_BYTES", 4)
    with pytest.raises(ValueError, match="loadings"):
        lr.fill_low_rank(df, ["a"], np.ones((1, 1)), 1.0)
    monkeypatch.setattr(lr, "SLICE_NUMBERS", 7)
    x = pd.DataFrame({"a": [1.0, np.nan, 3.0], "b": [2.0, 4.0, np.nan]}).to_numpy()
    assert np.allclose(lr.row_factors(x, np.ones((2, 1)), 1.0).ravel(), [1.0, 2.0, 1.5])
