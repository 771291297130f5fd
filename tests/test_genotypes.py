import numpy as np
import pytest

from tessella.operators import genotypes as gt
from tessella.operators import origin

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def tables(spark):
    """Genotypes of seven variants, some missing, and phenotypes far from zero that depend on a variant's parent of origin."""
    rng = np.random.default_rng(3)
    n, m = 400, 7
    g = rng.choice([0, 1, 2], p=[0.5, 0.4, 0.1], size=(m, n))
    x = rng.normal(size=(n, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]]) + 1e4
    x[g[2] == 1] += rng.choice([-1.5, 1.5], size=(g[2] == 1).sum())[:, None] * np.array([1, -1, 0.5])
    g[5, 20:] = 0
    seen = rng.random((m, n)) < 0.9
    long = spark.createDataFrame([(f"v{v}", int(s), int(g[v, s])) for v in range(m) for s in range(n) if seen[v, s]] + [("v0", 5000, 1), ("v1", 3, None)], "v string, s long, g int")
    samples = spark.createDataFrame([(s, *map(float, x[s])) for s in range(n)] + [(9000, 1.0, None, 2.0), (9001, 1.0, float("nan"), 2.0)], "s long, a double, b double, c double")
    return long.repartition(5), samples, long.where("g is not null").join(samples, "s")


@pytest.mark.parametrize("cells", [2_000_000, 900])
def test_moments_effects_and_omnibus_equal_those_of_rows(tables, monkeypatch, cells):
    monkeypatch.setattr(gt, "CELLS", cells)
    long, samples, rows = tables
    packed = gt.pack_genotypes(long, samples, "v", "s", "g", COLUMNS)
    got = {(r.v, r.genotype): r for r in gt.packed_moments(packed).collect()}
    for r in origin.genotype_moments(rows, "v", "g", COLUMNS, (0, 1, 2)).collect():
        for k in (0, 1, 2):
            if r[f"n_{k}"]:
                own = got.pop((r.v, k))
                assert own.n == r[f"n_{k}"] and own["mean"] == pytest.approx(r[f"mean_{k}"]) and own.covariance == pytest.approx(r[f"cov_{k}"], rel=1e-6, abs=1e-7)
    assert not got
    many = {r.v: r for r in origin.many_variants(rows, "v", "g", COLUMNS).collect()}
    for r in gt.packed_effects(packed).collect():
        assert (r.n_homozygotes, r.n_heterozygotes) == (many[r.v].n_homozygotes, many[r.v].n_heterozygotes)
        assert r.effect is None and many[r.v].effect is None or np.allclose(np.abs(r.effect), np.abs(many[r.v].effect)) and r.p_value == pytest.approx(many[r.v].p_value)
    omnibus = {r.v: r for r in origin.poirot_variants(rows, "v", "g", COLUMNS).collect()}
    found = gt.packed_poirot(packed).collect()
    assert len(found) == 7
    for r in found:
        assert r.statistic == pytest.approx(omnibus[r.v].statistic) and r.p_value == pytest.approx(omnibus[r.v].p_value)


def test_resamples_follow_the_law_of_those_of_rows(tables):
    long, samples, rows = tables
    some = lambda df: df.where("v in ('v2', 'v3', 'v5')")
    got = {r.v: r for r in gt.packed_resamples(gt.pack_genotypes(some(long), samples, "v", "s", "g", COLUMNS), 300, 300).collect()}
    want = {r.v: r for r in origin.resampled_variants(some(rows), "v", "g", COLUMNS, 300, 300).collect()}
    assert got["v5"].permutation_p is None and want["v5"].permutation_p is None
    for v in ("v2", "v3"):
        assert got[v].permutation_p == pytest.approx(want[v].permutation_p, abs=0.1)
    assert np.allclose(np.abs(got["v2"].low), np.abs(want["v2"].low), atol=0.3) or np.allclose(np.abs(got["v2"].low), np.abs(want["v2"].high), atol=0.3)


def test_empty_and_too_large_tables(tables, monkeypatch):
    long, samples, _ = tables
    assert gt.packed_moments(gt.pack_genotypes(long.limit(0), samples, "v", "s", "g", COLUMNS)).collect() == []
    assert gt.packed_moments(gt.pack_genotypes(long, samples.limit(0), "v", "s", "g", COLUMNS)).collect() == []
    monkeypatch.setattr(gt, "SAMPLE_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        gt.pack_genotypes(long, samples, "v", "s", "g", COLUMNS)


@pytest.mark.parametrize(("cells", "summed"), [(2_000_000, 8_000_000), (50, 40)])
def test_few_genotypes_of_many_samples(spark, monkeypatch, cells, summed):
    """F3 of round 4: a block had a byte for each variant and sample, also for samples without a genotype."""
    monkeypatch.setattr(gt, "CELLS", cells)
    monkeypatch.setattr(gt, "SUMMED", summed)
    rng = np.random.default_rng(8)
    m, n = 300, 3000
    x = rng.normal(size=(n, 2)) + [1e4, -3]
    called = {(int(v) if v else None, int(s)): int(rng.integers(-1, 4)) for v, s in zip(rng.integers(0, m, 1500), rng.integers(0, n, 1500), strict=True)}
    called |= {(7, s): s % 3 for s in range(n)}
    rows = [(v, s, g) for (v, s), g in called.items()] + [(v, s, g - 1) for (v, s), g in called.items() if s % 2]
    long = spark.createDataFrame(rows, "v int, s long, g int").repartition(4)
    samples = spark.createDataFrame([(s, *map(float, x[s])) for s in range(n)], "s long, a double, b double")
    packed = gt.pack_genotypes(long, samples, "v", "s", "g", ["a", "b"])
    assert packed.blocks.selectExpr("sum(length(dosages))").first()[0] == len(called)
    got = {(r.v, r.genotype): r for r in gt.packed_moments(packed).collect()}
    groups = {}
    for (v, s), g in called.items():
        if g in (0, 1, 2):
            groups.setdefault((v, g), []).append(s)
    assert got.keys() == groups.keys()
    for key, own in groups.items():
        assert got[key].n == len(own) and got[key]["mean"] == pytest.approx(x[own].mean(axis=0), rel=1e-12)
        assert got[key].covariance == pytest.approx(np.cov(x[own].T, bias=True)[[0, 0, 1], [0, 1, 1]] if len(own) > 1 else [0, 0, 0], abs=1e-9)
