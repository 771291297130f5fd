import numpy as np
import pandas as pd
import pytest

from tessella.operators import gradients as gd
from tessella.operators import latent


def frame(spark, x, names, parts=3):
    return spark.createDataFrame(pd.DataFrame(x, columns=list(names))).repartition(parts)


@pytest.fixture(scope="module")
def factors(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(size=(2, 6))
    x = rng.normal(size=(3000, 2)) @ w + rng.normal(size=(3000, 6)) * np.array([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) + 3
    return frame(spark, x, "abcdef").cache()


def gap(a, b):
    return np.abs(a.covariance().matrix - b.covariance().matrix).max() / np.abs(b.covariance().matrix).max()


def test_gradients_reach_the_closed_forms(factors):
    names = list("abcdef")
    found = gd.factor_model_sgd(factors, names, 2, rounds=120, rate=0.1)
    assert gap(found, latent.factor_analysis(factors, names, 2)) < 0.02 and np.allclose(found.mean, 3, atol=0.2)
    centred = factors.selectExpr(*[f"{c} - {m} as {c}" for c, m in zip(names, found.mean.tolist())])
    assert gap(gd.factor_model_sgd(centred, names, 2, shared_noise=True, rounds=120, rate=0.1), latent.ppca(centred, names, 2)) < 0.02


def test_rounds_over_a_share_of_the_blocks_come_near(factors, monkeypatch):
    monkeypatch.setattr(gd, "BLOCK_ROWS", 100)
    names = list("abcdef")
    assert gap(gd.factor_model_sgd(factors, names, 2, rounds=100, rate=0.1, share=0.3), latent.factor_analysis(factors, names, 2)) < 0.15


def test_logistic_on_rows_equals_that_of_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (rng.random((400, 3)) < 1 / (1 + np.exp(-x @ rng.normal(size=(5, 1)) @ rng.normal(size=(1, 3))))).astype(float)
    df = frame(spark, np.hstack([x, y]), ["a", "b", "c", "d", "e", "y0", "y1", "y2"])
    got = gd.reduced_rank_logistic_rows(df, list("abcde"), ["y0", "y1", "y2"], l1=0.01, nuclear=0.05, rounds=20)
    want = latent.reduced_rank_logistic(x, y, 0.01, 0.05, rounds=20)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_random_field_on_rows_follows_that_of_matrices(spark):
    rng = np.random.default_rng(2)
    a = rng.random(1500) < 0.5
    z = np.column_stack([a, np.where(rng.random(1500) < 0.9, a, ~a), rng.random(1500) < 0.4]).astype(float)
    df = frame(spark, z, "abc")
    h, j, c = gd.mrf_nce_rows(df, list("abc"), rounds=60, rate=0.3)
    want = latent.mrf_nce(z, rounds=60, rate=0.3)
    assert np.allclose(h, want[0], atol=0.15) and np.allclose(j, want[1], atol=0.15) and abs(c - want[2]) < 0.1
    scored = gd.mrf_scores(df, list("abc"), h, j).toPandas()
    assert np.allclose(scored["score"], latent.mrf_score(scored[list("abc")].to_numpy(), h, j))


def test_missing_rows_empty_tables_and_large_weights(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (3.0, 4.0)], "a double, b double")
    with gd.Blocks(df, ["a", "b"]) as data:
        n, (total,) = data.sums(lambda x, *_: [x.sum(axis=0)], [])
        assert (n, data.n, total.tolist()) == (2, 2, [4.0, 6.0])
        monkeypatch.setattr(gd, "WEIGHT_BYTES", 10)
        with pytest.raises(ValueError, match="weights"):
            data.sums(lambda x, *_: [x.sum(axis=0)], [np.zeros(9)])
    with pytest.raises(ValueError, match="no rows"):
        gd.factor_model_sgd(df.limit(0), ["a", "b"], 1)
