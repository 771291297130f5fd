import numpy as np
import pandas as pd
import pytest

from tessella.operators import batch, imputation, origin
from tessella.operators.moments import of_matrix

N = np.nan


def long_of(spark, x):
    return spark.createDataFrame([(i, j, None if v != v else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "sample int, variant long, dosage double")


def wide_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["sample"], r["variant"]] = np.nan if r["dosage"] is None else r["dosage"]
    return out


@pytest.mark.parametrize(("neighbours", "width", "columns"), [(5, 5, 12), (1, 2, 80), (3, 40, 70)])
def test_knn_dosage_matches_a_loop(spark, neighbours, width, columns):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (14, columns)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0, 1], x[3, 0] = -1, -1
    x[:, 5] = np.nan
    known = np.where(x < 0, np.nan, x)
    want = known.copy()
    for i, j in np.argwhere(np.isnan(known)):
        rows = np.flatnonzero(~np.isnan(known[:, j]))
        low, high = max(0, j - width), min(columns, j + width + 1)
        both = ~np.isnan(known[i, low:high])[None] & ~np.isnan(known[rows, low:high])
        d = ((known[i, low:high][None] != known[rows, low:high]) & both).sum(axis=1)
        votes = known[rows[np.argsort(d, kind="stable")][:neighbours], j]
        if len(votes):
            values, n = np.unique(votes, return_counts=True)
            want[i, j] = values[n == n.max()].min()
    got = imputation.knn_dosage(long_of(spark, x), neighbours=neighbours, width=width)
    assert np.array_equal(wide_of(got, x.shape), want, equal_nan=True) and got.count() == x.size


@pytest.mark.parametrize("bins", [4096, 3])
def test_median_of_any_values(spark, monkeypatch, bins):
    monkeypatch.setattr(imputation, "BINS", bins)
    monkeypatch.setattr(imputation, "SORTED", 2)
    rng = np.random.default_rng(6)
    for values in ([1.0], [2.0, 1.0], [5.0] * 7 + [1.0, 9.0], [1e-300, 1e300, 3.0, 4.0], (rng.normal(size=101) ** 9).tolist(), [1.0, 1.0 + 1e-16, 1.0 + 2e-16, 7.0], [-3.0, -1e9, 0.0, 1e9]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
        assert imputation.median(df, "x") == np.median(values)
    assert imputation.median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_validation(spark):
    df = long_of(spark, [[0, 5], [N, N]])
    assert [(r["sample"], r["variant"]) for r in imputation.check_dosages(df).collect()] == [(0, 1)]
    assert [r[0] for r in imputation.fully_missing(df, "sample").collect()] == [1]


def test_fill(spark):
    df = spark.createDataFrame([(1.0, "a"), (N, "b"), (None, "c"), (4.0, "d")], "x double, k string")
    for kind, want in (("mean", 2.5), ("median", 2.5), ("zero", 0.0)):
        assert sorted(r.x for r in imputation.fill(df, ["x"], kind).collect()) == sorted([1.0, want, want, 4.0])
    with pytest.raises(ValueError):
        imputation.fill(df, ["x"], "mode")


def test_completion_by_group(spark):
    rng = np.random.default_rng(0)
    parts, truth = [], []
    for g in "pq":
        x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 8))
        gaps = rng.random(x.shape) < 0.1
        parts.append(pd.DataFrame(np.where(gaps, np.nan, x), columns=[f"c{k}" for k in range(8)]).assign(g=g, r=range(40)))
        truth.append((x, gaps))
    df = spark.createDataFrame(pd.concat(parts))
    for solver in imputation.SOLVERS:
        got = imputation.complete_groups(df, "g", "r", [f"c{k}" for k in range(8)], solver).toPandas()
        for g, (x, gaps) in zip("pq", truth):
            own = got[got.g == g].sort_values("r").drop(columns=["g", "r"]).to_numpy()
            assert not np.isnan(own).any() and np.allclose(own[~gaps], x[~gaps], atol=2e-3) and np.mean((own[gaps] - x[gaps]) ** 2) < 0.7 * x[gaps].var()


def test_mean_and_rotation_adaptation(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(4):
        a = rng.normal(size=(3, 3)) + 2 * np.eye(3)
        rows += [(f"b{k}", *r) for r in (rng.normal(size=(300, 3)) @ a + k).tolist()]
    df = spark.createDataFrame(rows, "b string, x double, y double, z double")
    for out in (batch.mean_adaptation(df, "b", ["x", "y", "z"]), batch.rotation_adaptation(df, "b", ["x", "y", "z"])):
        got = out.toPandas()
        means = got.groupby("b")[["x", "y", "z"]].mean().to_numpy()
        assert np.allclose(means, means[0], atol=1e-8)
    covs = [np.cov(g[["x", "y", "z"]].T) for _, g in got.groupby("b")]
    assert all(np.linalg.norm(c - covs[0]) < 0.05 * np.linalg.norm(covs[0]) for c in covs)
    half = batch.mean_adaptation(df, "b", ["x"], 1.0).toPandas()
    assert abs(half.x.mean()) < 1e-9


@pytest.mark.parametrize("bayes", [False, True])
def test_batch_error_falls(spark, bayes):
    rng = np.random.default_rng(2)
    theta, values, controls = rng.normal(0, 1.8, 70), [], []
    for k in range(70):
        values += [(k, i, float(theta[k] + d + rng.normal()), float(d)) for i, d in enumerate(rng.normal(size=15))]
        controls += [(k, r, float(theta[k] + rng.normal())) for r in range(3 if bayes else 1)]
    v = spark.createDataFrame(values, "batch int, i int, x double, truth double")
    c = spark.createDataFrame(controls, "batch int, replicate int, control double")
    out = batch.bayesian_adaptation(v, c, 300, 100) if bayes else batch.univariate_adaptation(v, c.drop("replicate"), resamples=200)
    before, after = (np.mean((p.x - p.x.mean() - p.truth) ** 2) for p in (v.toPandas(), out.toPandas()))
    assert after < 0.8 * before


def test_constrained_least_squares():
    a = np.array([[1.0, 1, 1], [1, 1, 0], [1, 0, 1]])
    assert np.allclose(batch.constrained_least_squares(a, a @ np.array([1.0, 2, 3]), 0), [1, 2, 3])
    assert (batch.constrained_least_squares(a, np.array([-1.0, 2, 3]), 0.1) >= 0.1 - 1e-9).all()


@pytest.fixture(scope="module")
def trio():
    rng = np.random.default_rng(4)
    beta = np.array([1.5, -1, 0.5, 0, 0, 2.0])
    g = rng.random((6000, 2)) < 0.25
    x = rng.normal(size=(6000, 6))
    x[:, 0] += 0.5 * x[:, 1]
    het = g.sum(axis=1) == 1
    x[het] += np.where(g[het][:, :1], 0.5, -0.5) * beta
    return x, g.sum(axis=1), beta


def cosine(a, b):
    return abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b)


def test_single_variant(spark, trio):
    x, y, beta = trio
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")).assign(y=y))
    for p in origin.P_VALUES:
        out = origin.single_variant(df, "y", list("abcdef"), p_value=p)
        assert cosine(out["effect"], beta) > 0.95 and out["reference"] == 0
    assert out["p_value"] < 0.01 and origin.single_variant(df, "y", list("abcdef"), loss="F_1")["p_value"] < 0.01
    with pytest.raises(ValueError):
        origin.single_variant(df.limit(20), "y", list("abcdef"))
    shuffled = pd.DataFrame(x, columns=list("abcdef")).assign(y=np.random.default_rng(0).permutation(y))
    assert origin.single_variant(spark.createDataFrame(shuffled), "y", list("abcdef"), check=False)["p_value"] > 0.001


def test_many_variants_agree_with_single(spark, trio):
    x, y, beta = trio
    rng = np.random.default_rng(5)
    a = pd.DataFrame(x, columns=list("abcdef")).assign(v=1, y=y)
    b = a.assign(v=2, y=rng.permutation(y))
    c = a.head(30).assign(v=3)
    got = {r.v: r for r in origin.many_variants(spark.createDataFrame(pd.concat([a, b, c])), "v", "y", list("abcdef")).collect()}
    single = origin.effect_of(of_matrix(x[y == 0]), of_matrix(x[y == 1]))
    assert cosine(np.array(got[1].effect), beta) > 0.95 and np.allclose(np.abs(got[1].effect), np.abs(single)) and got[1].p_value < 1e-3 < got[2].p_value and got[3].effect is None
    omni = {r.v: r.p_value for r in origin.poirot_variants(spark.createDataFrame(pd.concat([a, b])), "v", "y", list("abcdef")).collect()}
    assert omni[1] < 1e-3 < omni[2]
    small = slice(0, 800)
    assert origin.permutation_p(spark, x[small], y[small], permutations=40) < 0.1
    interval = origin.bootstrap_interval(spark, x, y, replicates=100)
    assert (interval[:, 0] <= single + 0.2).all() and (interval[:, 1] >= single - 0.2).all()
    frame = spark.createDataFrame(pd.concat([a, b, c]))
    each = {r.v: r for r in origin.single_variants(frame, "v", "y", list("abcdef")).collect()}
    one = origin.single_variant(frame.where("v = 1"), "y", list("abcdef"))
    assert np.allclose(each[1].effect, one["effect"]) and abs(each[1].p_value - one["p_value"]) < 1e-12 and each[1].reference == 0 and each[3].effect is None
    again = {r.v: r for r in origin.resampled_variants(spark.createDataFrame(pd.concat([a[small], c])), "v", "y", list("abcdef"), 40, 60).collect()}
    assert again[1].permutation_p < 0.1 and all(low <= high for low, high in zip(again[1].low, again[1].high)) and again[3].permutation_p is None


def test_centring_and_calls(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, 8.0), (1, 5.0), (None, 2.0)], "g int, x double")
    got = {(r.g, r.x): r.x_centred for r in origin.centre_by_group(df, "g", ["x"]).collect()}
    assert got == {(0, 1.0): -2, (0, 3.0): 0, (0, 8.0): 5, (1, 5.0): 0, (None, 2.0): 0}
    assert {r.x_mean for r in origin.group_means(df, "g", ["x"]).collect()} == {4.0, 5.0, 2.0}
    assert sorted(r[0] for r in df.select(origin.call_parent(["x"], [2.5], [1.0])).collect()) == [False, False, True, True, True]
    x = np.random.default_rng(0).normal(size=(30, 2))
    z = np.random.default_rng(1).normal(size=(30, 1))
    assert np.allclose(origin.covariate_residuals(x + 3 * z, z).T @ z, 0, atol=1e-8)


def test_draws_of_many_cells_are_even_over_a_batch(spark, monkeypatch):
    monkeypatch.setattr(batch, "CELL_ROWS", 7)
    rows = [("a", float(k)) for k in range(60)] + [("b", 100.0)] + [("c", 200.0 + k % 2) for k in range(40)]
    got = batch.one_value_per_batch(spark.createDataFrame(rows, "batch string, x double"), 3000).toPandas()
    assert got.groupby("batch")["replicate"].nunique().to_dict() == {"a": 3000, "b": 3000, "c": 3000} and len(got) == 9000
    assert set(got.loc[got.batch == "b", "x"]) == {100.0}
    seen = got.loc[got.batch == "a", "x"].value_counts()
    assert len(seen) == 60 and seen.min() > 20 and seen.max() < 90
    assert abs((got.loc[got.batch == "c", "x"] == 200.0).mean() - 0.5) < 0.04


def test_votes_equal_those_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(imputation, "PAIRS", 11)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(17, 40)).astype(int)
    x[rng.random(x.shape) < 0.2] = -1
    x[:, 9] = -1
    names = [f"s{k}" for k in rng.permutation(17)]
    long = spark.createDataFrame([(names[i], j, int(x[i, j])) for i in range(17) for j in range(40)], "sample string, variant int, dosage int")
    got = {(r["sample"], r["variant"]): r["dosage"] for r in imputation.knn_dosage(long, width=3, neighbours=4).collect()}
    order = sorted(range(17), key=lambda i: names[i])
    for i in range(17):
        for j in range(40):
            want = int(x[i, j])
            if want < 0:
                around = range(max(0, j - 3), min(40, j + 4))
                gap = lambda t, i=i, around=around: sum(x[i, k] >= 0 and x[t, k] >= 0 and x[i, k] != x[t, k] for k in around)
                best = sorted((t for t in order if x[t, j] >= 0), key=gap)[:4]
                said = [int(x[t, j]) for t in best]
                want = min(set(said), key=lambda v: (-said.count(v), v)) if said else None
            assert got[names[i], j] == want


@pytest.mark.parametrize(("samples", "known", "width"), [(60, 0.3, 2), (60, 0.9, 5), (400, 0.3, 5)])
def test_votes_of_small_blocks_and_batches_equal_those_of_a_loop(spark, monkeypatch, samples, known, width):
    """F2 of round 4: blocks that cut windows, candidates that come in several batches, samples without a name."""
    for name, value in (("BLOCK", 8), ("WINDOW_BYTES", 200), ("FIRST_MET", 2), ("MET", 8), ("REMEMBERED", 3), ("PAIRS", 50)):
        monkeypatch.setattr(imputation, name, value)
    rng = np.random.default_rng(samples)
    x = np.where(rng.random((samples, 13)) < known, rng.integers(0, 3, (samples, 13)), -1)
    x[:, 3] = -1
    named = [None if k == samples - 1 else f"s{k:03d}" for k in range(samples)]
    cells = [(named[i], j - 6, int(x[i, j])) for i in range(samples) for j in range(13) if x[i, j] >= 0 or (i + j) % 7 == 0]
    long = spark.createDataFrame(cells, "sample string, variant int, dosage int").repartition(3)
    got = {(r["sample"], r["variant"]): r["dosage"] for r in imputation.knn_dosage(long, width=width).collect()}
    assert len(got) == len(cells)
    for s, v, d in cells:
        i, j = samples - 1 if s is None else int(s[1:]), v + 6
        if d < 0:
            low, high = max(0, j - width), j + width + 1
            rows = np.flatnonzero(x[:, j] >= 0)
            differ = ((x[rows, low:high] != x[i, low:high]) & (x[rows, low:high] >= 0) & (x[i, low:high] >= 0)).sum(axis=1)
            votes = x[rows[np.argsort(differ, kind="stable")][:5], j]
            d = int(np.bincount(votes).argmax()) if len(votes) else None
        assert got[s, v] == d


def test_missing_cells_meet_few_candidates(spark):
    """F2 of round 4: every missing cell was compared with all samples of its variant; those after five that are as near to any cell are left out."""
    n = 20_000
    cells = spark.range(n * 6).selectExpr("id div 6 AS s", "id % 6 AS j", "CAST(CASE WHEN id % 29 = 0 THEN NULL ELSE pmod(hash(id), 3) END AS INT) AS d").where("d is null or pmod(hash(id, 1), 4) = 0").coalesce(1)
    met = imputation.neighbour_windows(cells, 5, 5).groupBy("j").pivot("known", [False, True]).count().collect()
    assert len(met) == 6 and all(r["false"] > 600 and 5 <= r["true"] < 2000 for r in met)
    assert imputation.knn_dosage(cells.limit(0).toDF("sample", "variant", "dosage")).count() == 0
