import numpy as np
import pandas as pd
import pytest

from tessella.operators import hypothesis, resampled
from tessella.operators import rowtests as rt


def frame(spark, x, parts=3):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"v{k}" for k in range(x.shape[1])])).repartition(parts)


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(5, 5)) / 3 + np.eye(5)
    return rng.normal(size=(120, 5)) @ mix + 50, rng.normal(size=(90, 5)) @ (mix + 0.05) - 20


NAMES = [f"v{k}" for k in range(5)]


def test_super_diagonals_equal_those_of_matrices(spark, samples):
    x, y = samples
    got = [r["p"] for r in rt.super_diagonal_rows(frame(spark, x), frame(spark, y), NAMES, 4).orderBy("replicate").collect()]
    want = [resampled.super_diagonal_p(x - x.mean(axis=0), y - y.mean(axis=0), k) for k in range(5)]
    assert np.allclose(got, want, rtol=1e-6)


def test_squares_equal_means_over_different_rows(samples):
    a, b = samples[0][:7, :1] - 50, samples[0][:7, 1:2] - 50
    sums = {(i, j): (a**i * b**j).sum(axis=0) for i, j in rt.POWERS}
    from itertools import permutations

    n, own = 7, range(7)
    two = np.mean([a[i] * b[i] * a[j] * b[j] for i, j in permutations(own, 2)])
    three = np.mean([a[i] * b[j] * a[k] * b[k] for i, j, k in permutations(own, 3)])
    four = np.mean([a[i] * b[j] * a[k] * b[m] for i, j, k, m in permutations(own, 4)])
    assert np.isclose(rt._square(sums, n)[0], two - 2 * three + four)


def test_multiplier_law_is_that_of_multipliers(spark, samples, monkeypatch):
    x, y = samples
    monkeypatch.setattr(rt, "SLICE_NUMBERS", 50)
    stat, law = rt.multiplier_law(frame(spark, x), frame(spark, y), NAMES)
    parts, scale = [], 0
    for s in (x, y):
        w = s - s.mean(axis=0)
        i, j = np.triu_indices(5)
        d = w[:, i] * w[:, j]
        parts.append(d - d.mean(axis=0))
        scale = scale + d.var(axis=0) / len(s)
    want = sum((d / (len(d) * np.sqrt(scale))).T @ (d / (len(d) * np.sqrt(scale))) for d in parts)
    assert np.allclose(law, want)
    by_rows = rt.multiplier_bootstrap_rows(frame(spark, x), frame(spark, y), NAMES, 2000)
    by_matrix = hypothesis.multiplier_bootstrap(spark, x, y, 2000)
    assert np.isclose(by_rows[0], by_matrix[0]) and np.isclose(stat, by_matrix[0]) and abs(by_rows[1] - by_matrix[1]) < 0.05


def test_missing_rows_small_samples_and_bounds(spark, samples, monkeypatch):
    x, y = samples
    holed = np.vstack([x, np.full((1, 5), np.nan)])
    assert np.isclose(rt.multiplier_law(frame(spark, holed), frame(spark, y), NAMES)[0], rt.multiplier_law(frame(spark, x), frame(spark, y), NAMES)[0])
    with pytest.raises(ValueError, match="second sample has 0"):
        rt.super_diagonal_rows(frame(spark, x), frame(spark, y).limit(0), NAMES, 1)
    same = rt.super_diagonal_rows(frame(spark, np.ones((9, 2))), frame(spark, np.ones((9, 2))), ["v0", "v1"], 1).collect()
    assert [r["p"] for r in same] == [None, None]
    monkeypatch.setattr(rt, "WEIGHT_BYTES", 8)
    with pytest.raises(ValueError, match="products"):
        rt.multiplier_law(frame(spark, x), frame(spark, y), NAMES)
