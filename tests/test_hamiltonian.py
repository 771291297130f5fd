import numpy as np
import pandas as pd
import pytest

from tessella.operators import batch
from tessella.operators import hamiltonian as hm


def test_draws_follow_a_normal_law():
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    inverse = np.linalg.inv(cov)
    density = lambda q: (-0.5 * float((q - 3) @ inverse @ (q - 3)), -inverse @ (q - 3))
    draws = np.array([hm.sample(density, np.zeros(2), 1500, 300, np.random.default_rng(k)) for k in range(4)])
    flat = draws.reshape(-1, 2)
    assert np.allclose(flat.mean(axis=0), 3, atol=0.12) and np.allclose(np.cov(flat.T), cov, atol=0.25)
    assert (hm.split_r_hat(draws) < 1.02).all()
    apart = draws + np.array([0, 0, 5, 5])[:, None, None]
    assert (hm.split_r_hat(apart) > 1.5).all()


def test_slopes_are_those_of_the_density():
    rng = np.random.default_rng(2)
    f = hm.batch_density(rng.normal(size=9), rng.integers(1, 6, 9).astype(float), rng.random(9))
    x = np.array([0.2, -0.7, 0.4])
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert np.isclose((f(x + step)[0] - f(x - step)[0]) / 2e-5, f(x)[1][k], rtol=1e-5)


@pytest.fixture(scope="module")
def controls(spark):
    rng = np.random.default_rng(5)
    rows = [(f"b{k:02d}", float(b + 0.7 * rng.normal())) for k, b in enumerate(rng.normal(size=40)) for _ in range(2 + k % 4)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["batch", "control"]))


def test_chains_agree_with_the_gibbs_sampler(spark, controls):
    values = spark.createDataFrame([(f"b{k:02d}", 0.0) for k in range(40)], "batch string, x double")
    gibbs = batch.bayesian_adaptation(values, controls, 2000, 500).toPandas().sort_values("batch")["x"].to_numpy()
    nuts = batch.bayesian_adaptation(values, controls, 400, 300, sampler="nuts").toPandas().sort_values("batch")["x"].to_numpy()
    assert np.abs(gibbs).max() > 0.5 and np.abs(gibbs - nuts).max() < 0.05
    with pytest.raises(ValueError, match="sampler"):
        batch.bayesian_adaptation(values, controls, sampler="x")


def test_r_hat_of_batch_chains(spark, controls):
    table = controls.toPandas().groupby("batch")["control"].agg(["mean", "count", lambda x: x.var(ddof=0)])
    m, n, v = table.to_numpy(dtype=float).T
    weights, r_hat = hm.batch_posterior(spark, m, n, v, samples=400)
    assert (r_hat < 1.05).all() and ((weights > 0) & (weights < 1)).all() and weights[n == 5].mean() > weights[n == 2].mean()
