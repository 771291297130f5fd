import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import special
from tessella.functions.randommatrix import MarchenkoPastur, WishartMax, WishartSpike, tracy_widom_cdf, tracy_widom_pdf, tracy_widom_quantile
from tessella.operators import covariance as cv
from tessella.operators import hypothesis as ht
from tessella.operators import latent
from tessella.operators import matrices as mx
from tessella.operators.moments import Moments, moments, of_matrix

def sample(seed, n=12, p=3):
    return np.random.default_rng(seed).normal(size=(n, p)) @ np.array([[1.0, 0.4, 0.0], [0.0, 1.3, 0.2], [0.0, 0.0, 0.7]])[:p, :p]


def plain_lrt(x, y):
    """-2 log likelihood ratio of two samples with n - 1 degrees of freedom each, by determinants."""
    n1, n2 = len(x) - 1, len(y) - 1
    s1, s2 = np.cov(x.T), np.cov(y.T)
    pool = (n1 * s1 + n2 * s2) / (n1 + n2)
    det = np.linalg.det
    return (n1 + n2) * math.log(det(pool)) - n1 * math.log(det(s1)) - n2 * math.log(det(s2))


def test_likelihood_ratios_match_determinants():
    x, y = sample(1), 2 * sample(2, 15)
    s = np.cov(x.T)
    assert abs(ht.lrt_one_sample(of_matrix(x))["lrt"] - (np.trace(s) - math.log(np.linalg.det(s)) - 3)) < 1e-9
    two = ht.lrt_two_sample(of_matrix(x), of_matrix(y))
    assert abs(two["lrt"] - plain_lrt(x, y)) < 1e-9 and abs(two["p_value"] - special.normal_sf(two["z_value"])) < 1e-12
    many = ht.lrt_many_samples([of_matrix(x), of_matrix(y)])
    assert abs(many["p_value"] - special.normal_sf(many["z_value"])) < 1e-12


#: Tables of the Tracy-Widom, Marchenko-Pastur and Wishart laws as published with the R package RMTstat (Johnstone, Ma, Perry,
#: Shahram 2014), and of the chi-squared, F, normal and gamma laws as in any textbook.
PUBLISHED = [
    (lambda: tracy_widom_cdf(0.8, 1), 0.93614), (lambda: tracy_widom_cdf(0.8, 2), 0.995671), (lambda: tracy_widom_quantile(0.8, 1), -0.165321), (lambda: tracy_widom_quantile(0.4, 2), -2.03004),
    (lambda: tracy_widom_pdf(0.4, 1), 0.1287189), (lambda: tracy_widom_pdf(0.8, 2), 0.01167142), (lambda: MarchenkoPastur(2, 3).pdf(0.3), 0.3809225), (lambda: MarchenkoPastur(3, 2).quantile(0.95), 2.638441),
    (lambda: MarchenkoPastur(2, 3).cdf(0.8), 0.5917404), (lambda: MarchenkoPastur(4, 3).quantile(0.01), 0.02713885), (lambda: WishartMax(3, 2).quantile(0.8), 2.449359), (lambda: WishartMax(3, 2).pdf(0.8), 0.2907871),
    (lambda: WishartSpike(5, 1, 3).pdf(0.3), 0.02532702), (lambda: WishartSpike(10, 1, 3).cdf(-1.9), 0.1451744),
    (lambda: special.chi2_sf(3.84, 1), 0.0500435), (lambda: special.f_sf(4.0, 3, 20), 0.0220), (lambda: special.normal_quantile(0.975), 1.959964), (lambda: special.gamma_quantile(2.5, 0.5), 2.1757),
]


@pytest.mark.parametrize(("got", "want"), PUBLISHED)
def test_published_values(got, want):
    assert abs(got() - want) < 1e-4


@pytest.mark.parametrize(("loss", "rule"), [("F_1", lambda l, c2: 1 + c2 * (l - 1)), ("N_1", lambda l, c2: max(1 + (l - 1) * (1 - 2 * (1 - c2)), 1)), ("O_1", lambda l, c2: l)])
def test_optimal_shrinkage(loss, rule):
    """The rules of Donoho, Gavish and Johnstone (2018) on a spike l and its cosine, solved from the eigenvalue by bisection."""
    gamma, top = 0.3, 17.0
    spread = lambda l: l * (1 + gamma / (l - 1))
    low, high = 1 + math.sqrt(gamma), top
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if spread(mid) < top else (low, mid)
    c2 = (1 - gamma / (low - 1) ** 2) / (1 + gamma / (low - 1))
    values, _ = mx.optimal_shrinkage(np.array([0.9, 1.1, top]), gamma, loss, 1.0)
    assert values[0] == values[1] == 1 and abs(values[-1] - rule(low, c2)) < 1e-6
    scaled, sigma = mx.optimal_shrinkage(np.array([0.9, 1.1, top]) * 4, gamma, loss)
    median = mx.optimal_shrinkage(np.array([0.9, 1.1, top]), gamma, loss)[1]
    assert abs(sigma / median - 2) < 1e-9 and scaled[-1] > scaled[0]


def test_all_losses_shrink():
    for loss in mx.SHRINKERS:
        values, _ = mx.optimal_shrinkage(np.array([0.5, 1.0, 9.0]), 0.4, loss, 1.0)
        assert values[0] == values[1] == 1 and values[2] <= 9
    with pytest.raises(ValueError):
        mx.optimal_shrinkage(np.ones(2), 0.4, "X")


def spd(seed, p=4):
    a = np.random.default_rng(seed).normal(size=(p, p + 3))
    return a @ a.T / p


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1000), st.integers(1001, 2000))
def test_laws_of_losses_means_and_geodesics(i, j):
    a, b = spd(i), spd(j)
    for loss in (mx.frobenius, mx.mahalanobis, mx.gaussian_kl, mx.symmetric_kl, mx.stein, mx.von_neumann, mx.harmonic, mx.log_euclidean, mx.bregman_schatten):
        assert abs(loss(a, a)) < 1e-8 and loss(a, b) > 0
    for mean in (mx.harmonic_mean, mx.log_euclidean_mean, mx.karcher_mean, mx.geometric_median, mx.riemannian_median):
        assert np.allclose(mean([a, a, a]), a, atol=1e-6) and mx.is_sym_pos_def(mean([a, b]))
    for name in mx.GEODESICS:
        assert np.allclose(mx.geodesic(a, b, 0.0, name), a) and np.allclose(mx.geodesic(a, b, 1.0, name), b)
    assert np.allclose(mx.karcher_mean([a, b]), mx.geodesic(a, b, 0.5), atol=1e-6)


def test_predicates():
    assert mx.is_symmetric(np.eye(2)) and mx.is_skew_symmetric(np.array([[0, 1], [-1, 0]])) and mx.is_hankel(np.array([[1, 2, 3], [2, 3, 4]])) and not mx.is_square(np.ones((2, 3)))
    assert mx.is_pos_semi_def(np.diag([0.0, 1])) and not mx.is_pos_def(np.diag([0.0, 1])) and mx.is_herm_pos_def(np.array([[2, 1j], [-1j, 2]])) and not mx.is_real_type(np.ones(1) * 1j)


def test_moments_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 3
    df = pd.DataFrame(x, columns=list("abcde")).assign(g=np.where(np.arange(500) % 3 == 0, "u", "v"))
    df.loc[0, "a"] = np.nan
    frame = spark.createDataFrame(df).repartition(4)
    found = moments(frame, list("abcde"), "g")
    for g in "uv":
        own = df[df.g == g].drop(columns="g").dropna().to_numpy()
        assert found[g].n == len(own) and np.allclose(found[g].covariance(), np.cov(own.T)) and np.allclose(found[g].mean, own.mean(axis=0))


def test_estimators():
    rng = np.random.default_rng(1)
    truth = np.diag([1.0, 2, 3, 4, 5, 6])
    m = of_matrix(rng.normal(size=(60, 6)) @ np.sqrt(truth))
    sample = np.linalg.norm(m.covariance() - truth)
    for name, f in cv.ESTIMATORS.items():
        assert mx.is_symmetric(f(m)) and mx.is_pos_semi_def(f(m)), name
    for f in (cv.nonlinear_shrinkage, cv.quadratic_inverse_shrinkage):
        assert np.linalg.norm(f(m) - truth) < 1.3 * sample
    wide = of_matrix(rng.normal(size=(30, 60)))
    assert mx.is_pos_def(cv.nonlinear_shrinkage(wide)) and mx.is_pos_def(cv.quadratic_inverse_shrinkage(wide))
    with pytest.raises(ValueError):
        cv.linear_inverse_shrinkage(wide)
    assert (cv.nonnegative(of_matrix(rng.normal(size=(30, 5)))) >= 0).all()
    x = rng.normal(size=(40, 4))
    s = np.cov(x.T)
    direct = sum(np.linalg.norm(np.outer(r, r) - s) ** 2 for r in x) / 40**2
    target = np.trace(s) / 4 * np.eye(4)
    w = min(direct, np.linalg.norm(s - target) ** 2) / np.linalg.norm(s - target) ** 2
    assert np.allclose(cv.linear_shrinkage(of_matrix(x), np.sum(np.sum(x**2, axis=1) ** 2)), w * target + (1 - w) * s)


def test_gaussian_quantities(spark):
    c = cv.Covariance(spd(3))
    x = np.random.default_rng(2).normal(size=(20, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    got = np.array([r[0] for r in df.select(c.log_likelihood(list("abcd"))).collect()])
    want = -2 * math.log(2 * math.pi) - 0.5 * np.linalg.slogdet(c.matrix)[1] - 0.5 * np.einsum("ni,ij,nj->n", x, np.linalg.inv(c.matrix), x)
    assert np.allclose(got, want)
    cond = np.array([r[0] for r in df.select(c.conditional_log_likelihood(list("abcd"), [1, 1, 0, 0])).collect()])
    marg = np.array([r[0] for r in df.select(c.marginal_log_likelihood(["a", "b"], [1, 1, 0, 0])).collect()])
    assert np.allclose(cond + marg, want)
    assert c.mutual_information([1, 0, 0, 0], [0, 1, 1, 0]) > 0 and c.stable_rank() >= 1
    assert c.predict(df, list("abcd"), [1, 1, 0, 0]).columns[-2:] == ["predicted_c", "predicted_d"]
    from pyspark.sql import functions as F

    assert abs(c.score(df, F.col("a"), F.lit(2.0), normalise=True) - x[:, 0].mean()) < 1e-9 and abs(c.score(df, F.col("a"), F.lit(2.0)) - 2 * x[:, 0].mean()) < 1e-9
    w, noise = np.random.default_rng(3).normal(size=(2, 5)), np.arange(1.0, 6)
    full = w.T @ w + np.diag(noise)
    assert np.allclose(cv.woodbury_inverse(w, noise), np.linalg.inv(full)) and abs(cv.woodbury_logdet(w, noise) - np.linalg.slogdet(full)[1]) < 1e-9


def test_tests_hold_their_level_and_have_power():
    rng = np.random.default_rng(5)
    null, power = {}, {}
    for _ in range(60):
        a, b, c = of_matrix(rng.normal(size=(80, 6))), of_matrix(rng.normal(size=(90, 6))), of_matrix(rng.normal(size=(90, 6)) * np.array([1, 1, 1, 1, 3, 3]))
        for name, f in {"john": ht.john, "nagao": ht.nagao, "lw": ht.ledoit_wolf, "fisher": ht.fisher, "srivastava": ht.srivastava_one_sample}.items():
            null.setdefault(name, []).append(f(a)[1])
            power.setdefault(name, []).append(f(c)[1])
        for name, f in {"sy": ht.srivastava_yanagihara, "s2007": ht.srivastava_2007, "schott": lambda g: ht.schott(*g), "lrt": lambda g: (0, ht.lrt_two_sample(*g)["p_value"])}.items():
            null.setdefault(name, []).append(f([a, b])[1])
            power.setdefault(name, []).append(f([a, c])[1])
    for name in null:
        assert np.mean(np.array(null[name]) < 0.05) < 0.25, name
        assert np.mean(np.array(power[name]) < 0.05) > 0.5, name
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) * 3
    assert ht.hotelling(of_matrix(x), of_matrix(x + 1))[1] < 1e-6


def test_multiplier_bootstrap(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) * 3
    assert ht.multiplier_bootstrap(spark, x, y, 300)[1] < 0.05 < ht.multiplier_bootstrap(spark, x, rng.normal(size=(60, 4)), 300)[1]


def test_samples_too_large_for_tasks_are_refused(spark, monkeypatch):
    from tessella.operators import replicates

    monkeypatch.setattr(replicates, "SAMPLE_BYTES", 1000)
    with pytest.raises(ValueError):
        ht.multiplier_bootstrap(spark, np.zeros((60, 4)), np.zeros((60, 4)), 3)


def test_trace_means_average_to_the_traces():
    """Monte Carlo of the estimates of tr(Sigma^k) / p, k to 4, from two pooled samples."""
    rng = np.random.default_rng(11)
    truth = np.array([1.0, 2.0, 3.0, 5.0])
    draws = [list(ht.trace_means([of_matrix(rng.normal(size=(n, 4)) * np.sqrt(truth)) for n in (25, 35)]).values()) for _ in range(4000)]
    assert np.allclose(np.mean(draws, axis=0), [np.mean(truth**k) for k in (1, 2, 3, 4)], rtol=0.03)


def test_trace_means_of_very_many_rows():
    """Estimates tend to the traces of the covariance itself, however large the counts get."""
    truth = np.diag([1.0, 2.0, 3.0, 5.0])
    for n in (10**5, 10**7, 10**10):
        got = ht.trace_means([Moments(n, np.zeros(4), truth * (n - 1)), Moments(n, np.zeros(4), truth * (n - 1))])
        assert np.allclose(list(got.values()), [np.mean(np.diag(truth) ** k) for k in (1, 2, 3, 4)], rtol=1e-3)


@pytest.mark.parametrize("test", [lambda g: ht.srivastava_yanagihara(g), lambda g: ht.srivastava_2007(g), lambda g: ht.sy2010(*g), lambda g: ht.schott(*g)])
def test_two_sample_tests_know_no_units_and_no_place(test):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(50, 5)) * 1.3
    want = test([of_matrix(x), of_matrix(y)])
    for scale, place in ((0.1, 0), (10, 0), (1, 1e6), (1000, -1e7)):
        assert np.allclose(test([of_matrix(x * scale + place), of_matrix(y * scale + place)]), want, rtol=1e-5)


def test_moments_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1000, 3)) + 1e8
    frame = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).repartition(7)
    assert np.allclose(moments(frame, list("abc"))[None].covariance(), np.cov(x.T), rtol=1e-6)
    entries = {(r.i, r.j): r.v for r in cv.sample_long(frame, list("abc")).collect()}
    assert all(abs(entries[i, j] - np.cov(x.T)[i, j]) < 1e-6 for i in range(3) for j in range(i, 3))
    both = of_matrix(x[:300]) + of_matrix(x[300:])
    assert np.allclose(both.covariance(), np.cov(x.T), rtol=1e-6) and np.allclose(both.mean, x.mean(axis=0))


def test_low_rank_covariance_equals_the_full_one(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(14)
    low = cv.LowRankCovariance(rng.normal(size=(2, 5)), np.arange(1.0, 6))
    full = cv.Covariance(low.w.T @ low.w + np.diag(low.noise))
    mask = [1, 0, 1, 1, 0]
    assert np.allclose(low.inverse(), full.precision())
    for a, b in zip(low.conditional(mask), full.conditional(mask), strict=True):
        assert np.allclose(a, b)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(20, 5)), columns=list("abcde")))
    names, seen = list("abcde"), list("acd")
    pairs = [(low.log_likelihood([F.col(c) for c in names]), full.log_likelihood(names)), (low.marginal_log_likelihood([F.col(c) for c in seen], mask), full.marginal_log_likelihood(seen, mask)), (low.conditional_log_likelihood([F.col(c) for c in names], mask), full.conditional_log_likelihood(names, mask))]
    got = np.array(df.select(*[c for p in pairs for c in p]).collect())
    assert np.allclose(got[:, ::2], got[:, 1::2])


def test_asymmetry_warns():
    with pytest.warns(UserWarning):
        cv.symmetric(np.array([[1.0, 0.5], [0.0, 1.0]]))


@pytest.mark.parametrize("cell", [3, 10**6])
def test_benjamini_hochberg_by_ranges(spark, monkeypatch, cell):
    """Ranges of p-values, one of which a third of the tests have, and nulls; against one sorted list."""
    monkeypatch.setattr(ht, "CELL_VALUES", cell)
    rng = np.random.default_rng(15)
    p = [*(rng.random(60) ** 3).tolist(), *[0.5] * 30, None, None]
    rows = ht.benjamini_hochberg(spark.createDataFrame([(k, v) for k, v in enumerate(p)], "k int, p double").repartition(5)).collect()
    known = np.array([v for v in p if v is not None])
    pi0 = min(np.mean(known > 0.5) / 0.5, 1)
    rank = lambda v: int((known <= v).sum())
    for r in rows:
        if r.p is None:
            assert r["rank"] is None and r.p_adjusted is None
        else:
            want = min(1.0, min(v * len(known) / rank(v) for v in known if v >= r.p)) * pi0
            assert r["rank"] == rank(r.p) and abs(r.p_adjusted - want) < 1e-12 and r.rejected == (want <= 0.05)
    assert len(rows) == len(p)


def test_benjamini_hochberg_is_monotone(spark):
    p = [0.001, 0.2, 0.03, 0.04, 0.9, 0.01]
    rows = ht.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p double"), lam=None).orderBy("p").collect()
    got = [r.p_adjusted for r in rows]
    s = sorted(p)
    assert np.allclose(got, [min(min(1.0, s[k] * 6 / (k + 1)) for k in range(i, 6)) for i in range(6)]) and got == sorted(got)


def test_latent_models(spark):
    rng = np.random.default_rng(7)
    w = rng.normal(size=(2, 6)) * 2
    z = rng.normal(size=(2000, 2))
    x = z @ w + rng.normal(size=(2000, 6)) * 0.5
    y = z[:, :1] + rng.normal(size=(2000, 1)) * 0.1
    df = spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=[*"abcdef", "y"]))
    truth = w.T @ w + 0.25 * np.eye(6)
    close = lambda m: np.linalg.norm(m.covariance().matrix - truth) / np.linalg.norm(truth)
    assert close(latent.ppca(df, list("abcdef"), 2)) < 0.12 and close(latent.factor_analysis(df, list("abcdef"), 2)) < 0.12 and close(latent.ppca(df, list("abcdef"), 2, "NonLinear")) < 0.12
    holes = pd.DataFrame(np.where(rng.random(x.shape) < 0.1, np.nan, x), columns=list("abcdef"))
    assert close(latent.ppca_missing(spark.createDataFrame(holes), list("abcdef"), 2)) < 0.15
    model = latent.ppca(df, list("abcdef"), 2)
    factors = np.array(model.transform(df, list("abcdef")).select("factor_0", "factor_1").collect())
    assert np.linalg.lstsq(factors, z, rcond=None)[1].sum() / (z**2).sum() < 0.1
    found, _ = latent.supervised_ppca(df, list("abcdef"), ["y"], 1, mu=50.0)
    push, _ = latent.supervised_ppca(df, list("abcdef"), ["y"], 1, mu=50.0, adversarial=True)
    corr = lambda m: abs(np.corrcoef((x - m.mean) @ m.w[0], y[:, 0])[0, 1])
    assert corr(found) > 0.8 > 0.3 > corr(push)
    near, _ = latent.supervised_ppca(df, list("abcdef"), ["y"], 1, mu=50.0, sketch=5)
    assert corr(near) > 0.8


def test_classifiers_and_samplers():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6))
    u, v = rng.normal(size=(6, 1)), rng.normal(size=(1, 4))
    y = (rng.random((400, 4)) < 1 / (1 + np.exp(-3 * x @ u @ v))).astype(float)
    w, b = latent.reduced_rank_logistic(x, y, nuclear=0.05)
    s = np.linalg.svd(w, compute_uv=False)
    assert s[1] < 0.2 * s[0] and np.mean((x @ w + b > 0) == y) > 0.8
    z = (rng.random((600, 3)) < 0.3).astype(float)
    z[:, 1] = np.where(rng.random(600) < 0.9, z[:, 0], z[:, 1])
    h, j, _ = latent.mrf_nce(z)
    assert j[0, 1] > 1 > abs(j[0, 2]) and latent.mrf_score(z, h, j).shape == (600,)
    draws = latent.sgld(lambda t, r: t, np.zeros(1), 30_000, a=0.3, b=1.0, gamma=-0.1)
    assert abs(draws[2000:].var() - 1) < 0.3
    assert np.isfinite(latent.preconditioned_sgld(lambda t, r: t, np.ones(2), 100)).all()
    assert np.allclose(Moments(2, np.zeros(1), np.eye(1)).covariance(), 1) and mx.operator_shrinkage(np.array([0.5, 5.0]), 0.5)[0] == 0
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 30)) * 3
    noisy = low + rng.normal(size=(40, 30))
    assert np.linalg.norm(mx.optshrink(noisy, 2) - low) < np.linalg.norm(noisy - low)


def test_models_go_to_parquet_and_back(spark, tmp_path):
    from tessella.operators.persist import load_model, save_model

    model = latent.FactorModel(np.arange(6.0).reshape(2, 3), np.ones(3), np.zeros(3))
    save_model(spark, model, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"), latent.FactorModel)
    assert all(np.array_equal(getattr(back, k), getattr(model, k)) for k in ("w", "noise", "mean"))
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "m"), cv.Covariance)
