"""Registered queries of estimators, Gaussian scores, tests, losses and shrinkage on moments of the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import randommatrix
from tessella.operators import batch, covariance, hypothesis, matrices, moments, origin
from tessella.plans.registry import query, table

#: Columns a, b, c of the lineitem table in like units, and a group.
SCALED = {"a": ("l_quantity", "/ 15"), "b": ("l_discount", "* 30"), "c": ("l_tax", "* 40")}
NAMES = list(SCALED)
ROWS = "SELECT l_linestatus AS g, " + ", ".join(f"{x} {f} AS {k}" for k, (x, f) in SCALED.items()) + " FROM lineitem"


def scaled(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_linestatus").alias("g"), (F.col("l_quantity") / 15).alias("a"), (F.col("l_discount") * 30).alias("b"), (F.col("l_tax") * 40).alias("c"))


def _entries(value: str) -> str:
    """Columns s00, s01, ... of the upper triangle."""
    return ", ".join(f"{value.format(x=x, y=y)} AS s{i}{j}" for i, x in enumerate(NAMES) for j, y in enumerate(NAMES) if i <= j)


def _s(i: int, j: int, t: str = "") -> str:
    return f"{t}s{min(i, j)}{max(i, j)}"


def _sum(f, n: int = 2) -> str:
    return " + ".join(f(i, j) for i in range(3) for j in range(3)) if n == 2 else " + ".join(f(i) for i in range(3))


TRACE = _sum(lambda i: _s(i, i), 1)
SQUARE = _sum(lambda i, j: f"{_s(i, j)} * {_s(i, j)}")
PRODUCTS = ", ".join("{} AS q{}{}".format(" + ".join(f"{_s(i, k)} * {_s(k, j)}" for k in range(3)), i, j) for i in range(3) for j in range(3))
DET = "(s00 * s11 * s22 + 2 * s01 * s12 * s02 - s00 * s12 * s12 - s11 * s02 * s02 - s22 * s01 * s01)"
#: n, entries and traces t1 to t4 of the covariance per group g.
TRACES = f"""s AS (SELECT g, count(*) AS n, {_entries("covar_samp({x}, {y})")} FROM ({ROWS}) GROUP BY g), q AS (SELECT *, {PRODUCTS} FROM s),
    t AS (SELECT *, {TRACE} AS t1, {SQUARE} AS t2, {_sum(lambda i, j: f"q{i}{j} * {_s(i, j)}")} AS t3, {_sum(lambda i, j: f"q{i}{j} * q{i}{j}")} AS t4, ln({DET}) AS logdet FROM q)"""


def groups(spark, sf_dir):
    found = moments.moments(scaled(spark, sf_dir), NAMES, "g")
    return [found[k] for k in sorted(found)]


def rows(spark, values: list[tuple], schema: str):
    return spark.createDataFrame([tuple(round(float(v), 6) if isinstance(v, (float, np.floating)) else v for v in r) for r in values], schema)


@query(f"""WITH s AS (SELECT count(*) AS n, {_entries("covar_samp({x}, {y})")}, {_entries("sum({x} * {y})").replace(" AS s", " AS g")}, sum(power(a*a + b*b + c*c, 2)) AS f FROM ({ROWS})),
    d AS (SELECT *, ({TRACE}) / 3 AS mu, (f - 2 * ({_sum(lambda i, j: f"{_s(i, j)} * {_s(i, j).replace('s', 'g')}")}) + n * ({SQUARE})) / n / n AS spread FROM s),
    w AS (SELECT *, ({SQUARE}) - 3 * mu * mu AS distance FROM d)
    SELECT i, j, round(least(spread, distance) / distance * CASE WHEN i = j THEN mu ELSE 0 END + (1 - least(spread, distance) / distance) * v, 6) AS v
    FROM (SELECT *, unnest([0,0,0,1,1,2]) AS i, unnest([0,1,2,1,2,2]) AS j, unnest([s00,s01,s02,s11,s12,s22]) AS v FROM w)""")
def linear_shrinkage(spark, sf_dir):
    m = covariance.fit(scaled(spark, sf_dir), NAMES, "LinearShrinkage").matrix
    return rows(spark, [(i, j, m[i, j]) for i in range(3) for j in range(i, 3)], "i int, j int, v double")


TWO = "SELECT sum(l_quantity * l_quantity) / count(*) AS a, sum(l_quantity * l_tax) / count(*) AS b, sum(l_tax * l_tax) / count(*) AS d FROM lineitem"


@query(f"""WITH m AS ({TWO}) SELECT l_orderkey, l_linenumber, l_partkey, round(-0.5 * (ln(2 * pi() * a) + l_quantity * l_quantity / a), 6) AS marginal,
    round(-0.5 * (ln(2 * pi() * (d - b * b / a)) + power(l_tax - l_quantity * b / a, 2) / (d - b * b / a)), 6) AS conditional FROM lineitem, m""")
def gaussian_conditional(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    c = covariance.fit(line, ["l_quantity", "l_tax"])
    marginal, conditional = c.marginal_log_likelihood(["l_quantity"], [1, 0]), c.conditional_log_likelihood(["l_quantity", "l_tax"], [1, 0])
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.round(marginal, 6).alias("marginal"), F.round(conditional, 6).alias("conditional"))


@query(f"""WITH m AS ({TWO}), e AS (SELECT *, a * d - b * b AS det, (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS top FROM m)
    SELECT round(d / det, 6) AS precision_00, round(-b / det, 6) AS precision_01, round(a / det, 6) AS precision_11, round((a + d) / top, 6) AS stable_rank, round(b / a, 6) AS beta,
    round(d - b * b / a, 6) AS rest, round(0.5 * (2 * ln(2 * pi() * exp(1)) + ln(det)), 6) AS entropy, round(0.5 * (ln(2 * pi() * exp(1)) + ln(d)), 6) AS entropy_tax, round(-0.5 * ln(1 - b * b / (a * d)), 6) AS mutual FROM e""")
def gaussian_summary(spark, sf_dir):
    c = covariance.fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])
    inv, (beta, rest) = c.precision(), c.conditional([1, 0])
    row = (inv[0, 0], inv[0, 1], inv[1, 1], c.stable_rank(), beta[0, 0], rest[0, 0], c.entropy(), c.entropy_subset([0, 1]), c.mutual_information([1, 0], [0, 1]))
    return rows(spark, [row], ", ".join(f"{n} double" for n in ("precision_00", "precision_01", "precision_11", "stable_rank", "beta", "rest", "entropy", "entropy_tax", "mutual")))


@query(f"""WITH m AS ({TWO}), p AS (SELECT *, a * d - b * b AS det FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * b / d, 6) AS predicted_l_quantity,
    round((-ln(2 * pi()) - 0.5 * ln(det) - 0.5 * (d * l_quantity * l_quantity - 2 * b * l_quantity * l_tax + a * l_tax * l_tax) / det), 6) AS log_likelihood FROM lineitem, p""")
def low_rank_scores(spark, sf_dir):
    """The same by a covariance of one factor and noise, which two columns always have."""
    line = table(spark, sf_dir, "lineitem")
    m = covariance.fit(line, ["l_quantity", "l_tax"]).matrix
    load = np.sqrt(0.9 * m[1, 1])
    w = np.array([[m[0, 1] / load, load]])
    c = covariance.LowRankCovariance(w, np.diag(m) - w[0] ** 2)
    beta, _ = c.conditional([0, 1])
    score = c.log_likelihood([F.col("l_quantity"), F.col("l_tax")])
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_tax") * F.lit(float(beta[0, 0])), 6).alias("predicted_l_quantity"), F.round(score, 6).alias("log_likelihood"))


@query(f"""WITH {TRACES}, m AS (SELECT g, n - 1 AS n, 3.0 AS p, t1, t2, t3, t4 FROM t),
    e AS (SELECT *, n * n / ((n - 1.0) * (n + 2) * p) * (t2 - t1 * t1 / n) AS a2, n * n + n + 2.0 AS b, p / n AS c FROM m),
    f AS (SELECT *, power(n, 5) * b / ((n + 1.0) * (n + 2) * (n + 4) * (n + 6) * (n - 1) * (n - 2) * (n - 3)) / p * (t4 - 4.0 / n * t3 * t1 - (2.0 * n * n + 3 * n - 6) / (n * b) * t2 * t2 + 2 * (5.0 * n + 6) / (n * b) * t2 * t1 * t1 - (5.0 * n + 6) / (1.0 * n * n * b) * power(t1, 4)) AS a4 FROM e)
    SELECT g, round(n / sqrt(8 * (c * c + 12 * c + 8)) * (a4 - 2 * a2 + 1), 3) AS fisher, round(n * (a2 - 2 * t1 / p + 1) / 2, 3) AS srivastava FROM f""")
def one_sample_tests(spark, sf_dir):
    found = moments.moments(scaled(spark, sf_dir), NAMES, "g")
    return spark.createDataFrame([(g, round(float(hypothesis.fisher(m)[0]), 3), round(float(hypothesis.srivastava_one_sample(m)[0]), 3)) for g, m in sorted(found.items())], "g string, fisher double, srivastava double")


POOLED = ", ".join(f"sum((n - 1) * {_s(i, j)}) AS {_s(i, j)}" for i in range(3) for j in range(i, 3))
SY = f"""{TRACES}, v AS (SELECT sum(n - 1) AS n, {POOLED} FROM t), vq AS (SELECT *, {PRODUCTS} FROM v),
    vt AS (SELECT n * 1.0 AS n, 3.0 AS p, {TRACE} AS v1, {SQUARE} AS v2, {_sum(lambda i, j: f"q{i}{j} * {_s(i, j)}")} AS v3, {_sum(lambda i, j: f"q{i}{j} * q{i}{j}")} AS v4 FROM vq),
    a2 AS (SELECT *, v1 / (n * p) AS a1, (v2 - v1 * v1 / n) / (p * (n - 1) * (n + 2)) AS a2 FROM vt),
    a3 AS (SELECT *, (v3 / p - 3 * n * (n + 1) * p * a2 * a1 - n * p * p * power(a1, 3)) / (n * (n * n + 3 * n + 4)) AS a3 FROM a2),
    a4 AS (SELECT *, (v4 / p - p * 2 * n * (2 * n * n + 6 * n + 9) * a1 * a3 - p * p * 2 * n * (3 * n + 2) * a1 * a1 * a2 - p * n * (2 * n * n + 5 * n + 7) * a2 * a2 - n * power(p, 3) * power(a1, 4)) / (n * (power(n, 3) + 6 * n * n + 21 * n + 18)) AS a4 FROM a3),
    own AS (SELECT g, n - 1.0 AS m, t1 / 3 AS b1, (n - 1.0) * (n - 1) / ((n - 2.0) * (n + 1) * 3) * (t2 - t1 * t1 / (n - 1)) AS b2 FROM t)"""


@query(f"""WITH {SY}, e AS (SELECT b2 / (b1 * b1) AS gamma, 4 / (m * m) * (a2 * a2 / power(a1, 4) + 2 * m / p * (power(a2, 3) / power(a1, 6) - 2 * a2 * a3 / power(a1, 5) + a4 / power(a1, 4))) AS xi,
        b2 AS own, 4 / (m * m) * a2 * a2 * (1 + 2 * m * a4 / (p * a2 * a2)) AS eta FROM own, a4), c AS (SELECT sum(gamma / xi) / sum(1 / xi) AS c1, sum(own / eta) / sum(1 / eta) AS c2 FROM e)
    SELECT round(sum(power(gamma - c1, 2) / xi), 5) AS srivastava_yanagihara, round(sum(power(own - c2, 2) / eta), 5) AS srivastava_2007 FROM e, c""")
def sy_test(spark, sf_dir):
    own = groups(spark, sf_dir)
    return spark.createDataFrame([(round(hypothesis.srivastava_yanagihara(own)[0], 5), round(hypothesis.srivastava_2007(own)[0], 5))], "srivastava_yanagihara double, srivastava_2007 double")


XY = f"WITH {TRACES}, x AS (SELECT * FROM t WHERE g = 'F'), y AS (SELECT * FROM t WHERE g = 'O')"
CROSS = _sum(lambda i, j: f"x.{_s(i, j)} * y.{_s(i, j)}")
POOL = ", ".join(f"(x.{_s(i, j)} * x.n + y.{_s(i, j)} * y.n) / (x.n + y.n) AS {_s(i, j)}" for i in range(3) for j in range(i, 3))


@query(f"""{XY}, k AS (SELECT x.n - 1.0 AS n1, y.n - 1.0 AS n2, x.t1 AS x1, y.t1 AS y1, x.t2 AS x2, y.t2 AS y2, {CROSS} AS xy, {POOL} FROM x, y),
    e AS (SELECT *, n1 + n2 AS n, (n1 + 2) * (n1 - 1) AS e1, (n2 + 2) * (n2 - 1) AS e2, {TRACE} AS p1, {SQUARE} AS p2 FROM k)
    SELECT round(abs(((1 - (n1 - 2) / e1) * x2 + (1 - (n2 - 2) / e2) * y2 - 2 * xy - n1 / e1 * x1 * x1 - n2 / e2 * y1 * y1) / (2 * n / (n1 * n2) * abs(n * n / ((n + 2) * (n - 1)) * (p2 - p1 * p1 / n)))), 5) AS schott FROM e""")
def schott_test(spark, sf_dir):
    return spark.createDataFrame([(round(float(hypothesis.schott(*groups(spark, sf_dir))[0]), 5),)], "schott double")


@query(f"""WITH {TRACES} SELECT g, round(t1 - logdet - 3, 6) AS lrt,
    round((t1 - logdet - 3 - 3 * (1 + (1 - 3.0 / (n - 1)) / (3.0 / (n - 1)) * ln(1 - 3.0 / (n - 1))) + 0.5 * ln(1 - 3.0 / n)) / sqrt(-2 * ln(1 - 3.0 / n) - 6.0 / n), 3) AS z_value FROM t""")
def likelihood_ratio(spark, sf_dir):
    found = {g: hypothesis.lrt_one_sample(m) for g, m in moments.moments(scaled(spark, sf_dir), NAMES, "g").items()}
    return spark.createDataFrame([(g, round(float(v["lrt"]), 6), round(float(v["z_value"]), 3)) for g, v in sorted(found.items())], "g string, lrt double, z_value double")


TWO_BY_TWO = """WITH s AS (SELECT l_linestatus AS g, covar_samp(l_quantity / 15, l_quantity / 15) AS a, covar_samp(l_quantity / 15, l_tax * 40) AS b, covar_samp(l_tax * 40, l_tax * 40) AS d FROM lineitem GROUP BY 1),
    k AS (SELECT x.a AS xa, x.b AS xb, x.d AS xd, y.a AS ya, y.b AS yb, y.d AS yd, x.a * x.d - x.b * x.b AS dx, y.a * y.d - y.b * y.b AS dy FROM s x, s y WHERE x.g = 'F' AND y.g = 'O')"""


def _pair(spark, sf_dir):
    found = moments.moments(scaled(spark, sf_dir), ["a", "c"], "g")
    return found["F"].covariance(), found["O"].covariance()


@query(f"""{TWO_BY_TWO}, r AS (SELECT *, (yd * xa - 2 * yb * xb + ya * xd) / dy AS tr, (xd * ya - 2 * xb * yb + xa * yd) / dx AS back FROM k)
    SELECT round(0.5 * (tr - 2 + ln(dy / dx)), 6) AS gaussian_kl, round(0.5 * (tr + back) - 2, 6) AS symmetric_kl, round(tr - ln(dx / dy) - 2, 6) AS stein,
    round(power(xd / dx - yd / dy, 2) + 2 * power(xb / dx - yb / dy, 2) + power(xa / dx - ya / dy, 2), 6) AS harmonic, round(0.5 * (power(xa - ya, 2) + 2 * power(xb - yb, 2) + power(xd - yd, 2)), 6) AS bregman FROM r""")
def covariance_losses(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return rows(spark, [(matrices.gaussian_kl(a, b), matrices.symmetric_kl(a, b), matrices.stein(a, b), matrices.harmonic(a, b), matrices.bregman_schatten(a, b))], "gaussian_kl double, symmetric_kl double, stein double, harmonic double, bregman double")


@query(f"""{TWO_BY_TWO}, h AS (SELECT *, (xd / dx + yd / dy) / 2 AS p, -(xb / dx + yb / dy) / 2 AS q, (xa / dx + ya / dy) / 2 AS r FROM k)
    SELECT unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, round(unnest([0.75 * xa + 0.25 * ya, 0.75 * xb + 0.25 * yb, 0.75 * xd + 0.25 * yd]), 6) AS euclid,
    round(unnest([r, -q, p]) / (p * r - q * q), 6) AS harmonic_mean FROM h""")
def euclid_geodesic(spark, sf_dir):
    """A quarter of the way between two covariances, and their harmonic mean."""
    a, b = _pair(spark, sf_dir)
    way, mean = matrices.geodesic(a, b, 0.25, "euclid"), matrices.harmonic_mean([a, b])
    return rows(spark, [(i, j, way[i, j], mean[i, j]) for i, j in ((0, 0), (0, 1), (1, 1))], "i int, j int, euclid double, harmonic_mean double")


@query("""WITH s AS (SELECT DISTINCT p_size, p_size / 10.0 AS s FROM part), m AS (SELECT *, s * s - 1.5 AS m, s > 1 + sqrt(0.5) AS big FROM s), t AS (SELECT *, CASE WHEN big THEN (m + sqrt(greatest(m * m - 2, 0))) / 2 END AS t FROM m),
    e AS (SELECT *, CASE WHEN s > power(1 + sqrt(0.5), 2) THEN (s + 0.5 + sqrt(greatest(power(s + 0.5, 2) - 4 * s, 0))) / 2 END AS l FROM t),
    c AS (SELECT *, (1 - 0.5 / power(l - 1, 2)) / (1 + 0.5 / (l - 1)) AS c2 FROM e)
    SELECT p_size, round(CASE WHEN big THEN sqrt(t) * sqrt((t + 0.5) / (t + 1)) ELSE 0 END, 6) AS operator, round(CASE WHEN l IS NULL THEN 1 ELSE greatest(1 + c2 * (l - 1), 0) END, 6) AS frobenius FROM c""")
def shrink_op(spark, sf_dir):
    """Sizes as singular values and as eigenvalues of unit noise: both shrinkages at a ratio of a half."""
    sizes = [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]
    s = np.array(sizes) / 10.0
    both = zip(sizes, matrices.operator_shrinkage(s, 0.5), matrices.optimal_shrinkage(s, 0.5, "F_1", 1.0)[0], strict=True)
    return rows(spark, [(int(k), float(a), float(b)) for k, a, b in both], "p_size int, operator double, frobenius double")


@query("""SELECT DISTINCT p_size, round((s + 1) * (1 + 0.1 / s), 9) AS centre, round((s + 1) * sqrt(2 * (1 - 0.1 / (s * s))) / sqrt(200), 9) AS scale FROM (SELECT p_size, p_size * 1.0 AS s FROM part)""")
def spike_parameters(spark, sf_dir):
    sizes = [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().orderBy("p_size").collect()]
    found = [(k, *randommatrix.WishartSpike(float(k), 200.0, 20.0).parameters) for k in sizes]
    return spark.createDataFrame([(k, round(c, 9), round(s, 9)) for k, c, s in found], "p_size int, centre double, scale double")


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n_0, count(*) FILTER (l_returnflag <> 'A') AS n_1, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS mean_0, round(avg(l_tax) FILTER (l_returnflag <> 'A'), 6) AS mean_1,
    round(covar_pop(l_quantity, l_tax) FILTER (l_returnflag = 'A'), 6) AS cov_0, round(var_pop(l_tax) FILTER (l_returnflag <> 'A'), 6) AS var_1 FROM lineitem GROUP BY 1""")
def variant_moments(spark, sf_dir):
    """What parent_effects computes per variant from all rows, before its small matrices."""
    line = table(spark, sf_dir, "lineitem").withColumn("genotype", F.when(F.col("l_returnflag") == "A", 0).otherwise(1))
    m = origin.genotype_moments(line, "l_suppkey", "genotype", ["l_quantity", "l_tax"], (0, 1))
    return m.select("l_suppkey", "n_0", "n_1", F.round(F.col("mean_0")[0], 6).alias("mean_0"), F.round(F.col("mean_1")[1], 6).alias("mean_1"), F.round(F.col("cov_0")[1], 6).alias("cov_0"), F.round(F.col("cov_1")[2], 6).alias("var_1"))


@query("""WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS q, avg(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT g AS l_returnflag, n, round((SELECT avg(q) FROM m), 5) AS l_quantity, round((SELECT avg(t) FROM m), 5) AS l_tax, TRUE AS same_covariance FROM m""")
def rotation_invariants(spark, sf_dir):
    """After rotation_adaptation: every batch has the mean of means, and one covariance (up to the ridge)."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_tax") * 400).alias("l_tax"))
    out = batch.rotation_adaptation(line, "l_returnflag", ["l_quantity", "l_tax"], ridge=1e-9)
    own = out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"), F.covar_pop("l_quantity", "l_tax").alias("c"))
    spread = own.agg((F.max("c") - F.min("c")).alias("spread"))
    return own.crossJoin(F.broadcast(spread)).select("l_returnflag", "n", F.round("q", 5).alias("l_quantity"), F.round(F.col("t") / 400, 5).alias("l_tax"), (F.col("spread") < 1e-4).alias("same_covariance"))


@query("""WITH v AS (SELECT o_orderpriority AS batch, o_totalprice AS x FROM orders), w AS (SELECT batch, x - avg(x) OVER (PARTITION BY batch) AS d FROM v)
    SELECT batch, count(*) AS n, 200 AS draws, TRUE AS from_the_batch FROM v GROUP BY 1""")
def resampled_values(spark, sf_dir):
    """Draws of one value per batch: as many as asked for, each one of its own batch."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_totalprice").alias("x"))
    draws = batch.one_value_per_batch(v, 200)
    known = draws.join(v.distinct(), ["batch", "x"], "left_semi").groupBy("batch").agg(F.count("*").cast("int").alias("draws"))
    return v.groupBy("batch").agg(F.count("*").alias("n")).join(known, "batch").withColumn("from_the_batch", F.col("draws") == 200).select("batch", "n", "draws", "from_the_batch")


MINOR = {"i00": "s11 * s22 - s12 * s12", "i01": "s02 * s12 - s01 * s22", "i02": "s01 * s12 - s02 * s11", "i11": "s00 * s22 - s02 * s02", "i12": "s01 * s02 - s00 * s12", "i22": "s00 * s11 - s01 * s01"}
UPPER_ROWS = "unnest([0,0,0,1,1,2]) AS i, unnest([0,1,2,1,2,2]) AS j"


@query(f"""WITH s AS (SELECT {_entries("sum({x} * {y}) / count(*)")} FROM ({ROWS})), p AS (SELECT {", ".join(f"({m}) / {DET} AS {k}" for k, m in MINOR.items())} FROM s)
    SELECT {UPPER_ROWS}, round(unnest([{", ".join(MINOR)}]), 6) AS v FROM p""")
def empirical_precision(spark, sf_dir):
    inv = covariance.empirical_precision(moments.moments(scaled(spark, sf_dir), NAMES)[None])
    return rows(spark, [(i, j, inv[i, j]) for i in range(3) for j in range(i, 3)], "i int, j int, v double")


#: Noise of each column by its mean square, and one factor of the columns' means.
FACTOR_SQL = f"""m AS (SELECT {", ".join(f"avg({c}) AS w{k}, avg({c} * {c}) AS d{k}" for k, c in enumerate(NAMES))} FROM ({ROWS})),
    s AS (SELECT {", ".join(f"w{i} * w{j}{f' + d{i}' if i == j else ''} AS s{i}{j}" for i in range(3) for j in range(i, 3))} FROM m)"""


@query(f"""WITH {FACTOR_SQL}, p AS (SELECT ln({DET}) AS logdet, {", ".join(f"({m}) / {DET} AS {k}" for k, m in MINOR.items())} FROM s)
    SELECT {UPPER_ROWS}, round(unnest([{", ".join(MINOR)}]), 6) AS v, round(logdet, 6) AS logdet FROM p""")
def factor_inverse(spark, sf_dir):
    """Inverse and log determinant of a factor and noise through the small system, against cofactors of the whole matrix."""
    m = moments.moments(scaled(spark, sf_dir), NAMES)[None]
    w, noise = np.asarray(m.mean).reshape(1, -1), np.diag(covariance.empirical(m)).copy()
    inv, logdet = covariance.woodbury_inverse(w, noise), covariance.woodbury_logdet(w, noise)
    return rows(spark, [(i, j, inv[i, j], logdet) for i in range(3) for j in range(i, 3)], "i int, j int, v double, logdet double")
