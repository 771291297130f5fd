"""Registered queries of matrices with missing cells and of two-sample tests whose samples stay in rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import lowrank, rowtests
from tessella.plans.registry import query, table
from tessella.plans.statistics import NAMES, ROWS, scaled

#: Lines with holes in two of three columns, in like units.
HOLES = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity / 15 END AS a,
    CASE WHEN l_suppkey % 3 <> 0 THEN l_tax * 40 END AS b, l_discount * 30 AS c FROM lineitem"""


def _holes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    a, b = F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity") / 15), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax") * 40).otherwise(float("nan"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"), (F.col("l_discount") * 30).alias("c"))


def _seen(value: str) -> str:
    """The sum of a value over the observed ones of a, b, c."""
    return " + ".join(f"coalesce({value.format(c=c)}, 0)" for c in "abc")


@query(f"""WITH h AS ({HOLES}), r AS (SELECT *, ({_seen('{c}')}) / (2 + {_seen('{c} * 0 + 1')}) AS z FROM h),
    l AS (SELECT sum(a * z) / (2 + sum(z * z) FILTER (a IS NOT NULL)) AS wa, sum(b * z) / (2 + sum(z * z) FILTER (b IS NOT NULL)) AS wb, sum(c * z) / (2 + sum(z * z)) AS wc FROM r),
    f AS (SELECT h.*, wa, wb, wc, ({_seen('{c} * w{c}')}) / (2 + {_seen('({c} * 0 + 1) * w{c} * w{c}')}) AS y FROM h, l)
    SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(a, y * wa), 6) AS a, round(coalesce(b, y * wb), 6) AS b, round(coalesce(c, y * wc), 6) AS c FROM f""")
def low_rank_fill(spark, sf_dir):
    """Holes of all lines filled by rank 1 after one round of both ridge regressions."""
    rows, names = _holes(spark, sf_dir), ["a", "b", "c"]
    loadings = lowrank.soft_impute_rows(rows, names, shrinkage=2.0, rank=1, rounds=1, start=np.ones((3, 1)))
    out = lowrank.fill_low_rank(rows, names, loadings, 2.0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in names])


@query(f"""WITH h AS ({HOLES}), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM h), d AS (SELECT a - ma AS a, b - mb AS b, c - mc AS c FROM h, m),
    r AS (SELECT *, ({_seen('{c}')}) / (1 + {_seen('{c} * 0 + 1')}) AS z, 1 / (1 + {_seen('{c} * 0 + 1')}) AS v FROM d),
    s AS (SELECT sum(a * z) AS ha, sum(b * z) AS hb, sum(c * z) AS hc, sum(z * z + v) FILTER (a IS NOT NULL) AS ga, sum(z * z + v) FILTER (b IS NOT NULL) AS gb, sum(z * z + v) AS gc,
        sum({_seen('{c} * {c}')}) AS q, count(a) + count(b) + count(c) AS n FROM r)
    SELECT round(ha / ga, 6) AS a, round(hb / gb, 6) AS b, round(hc / gc, 6) AS c, round((q - ha * ha / ga - hb * hb / gb - hc * hc / gc) / n, 6) AS noise FROM s""")
def missing_factor_step(spark, sf_dir):
    """Loadings and noise of one factor after one round of expectation maximisation over all lines with holes."""
    model = lowrank.ppca_missing_rows(_holes(spark, sf_dir), ["a", "b", "c"], 1, rounds=1, start=(np.ones((3, 1)), 1.0))
    row = [round(float(v), 6) for v in (*model.w[0], model.noise[0])]
    return spark.createDataFrame([tuple(row)], "a double, b double, c double, noise double")


#: Lines by status, two samples of columns a, b, c, centred by group.
CENTRED = f"SELECT g, count(*) OVER (PARTITION BY g) AS n, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY g) AS {c}' for c in NAMES)} FROM ({ROWS})"
PRODUCTS = [(x, y) for i, x in enumerate(NAMES) for y in NAMES[i:]]


def _halves(spark, sf_dir):
    rows = scaled(spark, sf_dir)
    return rows.where("g = 'F'"), rows.where("g = 'O'")


def _law_sql() -> str:
    k = range(len(PRODUCTS))
    both = [(i, j) for i in k for j in k if i < j]
    products = ", ".join(f"{x} * {y} AS d{i}" for i, (x, y) in enumerate(PRODUCTS))
    moments = ", ".join([*(f"avg(d{i}) AS m{i}" for i in k), *(f"covar_pop(d{i}, d{j}) / count(*) AS v{i}{j}" for i in k for j in k if i <= j)])
    sums = ", ".join([*(f"sum(CASE g WHEN 'F' THEN m{i} ELSE -m{i} END) AS m{i}" for i in k), *(f"sum(v{i}{j}) AS v{i}{j}" for i in k for j in k if i <= j)])
    most = ", ".join(f"abs(m{i}) / sqrt(v{i}{i})" for i in k)
    shares = ", ".join(f"round(v{i}{j} / sqrt(v{i}{i} * v{j}{j}), 6) AS r{i}{j}" for i, j in both)
    return f"SELECT round(greatest({most}), 5) AS statistic, {shares} FROM (SELECT {sums} FROM (SELECT g, {moments} FROM (SELECT g, {products} FROM ({CENTRED})) GROUP BY g))"


@query(_law_sql())
def multiplier_law(spark, sf_dir):
    """The statistic of lines of either status, and the correlations of the law under Gaussian multipliers."""
    stat, law = rowtests.multiplier_law(*_halves(spark, sf_dir), NAMES)
    k = range(len(PRODUCTS))
    found = {"statistic": round(stat, 5)} | {f"r{i}{j}": round(float(law[i, j]), 6) for i in k for j in k if i < j}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} double" for c in found))


def _unbiased_square(t: str, k: str) -> str:
    """Product means over two, three and four different rows, from sums a (x), b (y), p (xy), q (xx), r (yy), u (xxy), w (xyy), v (xxyy)."""
    a, b, p, q, r, u, w, v = (f"{t}.{c}{k}" for c in "abpqruwv")
    n = f"{t}.n"
    two = f"({p} * {p} - {v})"
    three = f"({a} * {b} * {p} - {a} * {w} - {b} * {u} - {p} * {p} + 2 * {v})"
    four = f"({a} * {b} * {a} * {b} - {q} * {b} * {b} - {r} * {a} * {a} - 4 * {a} * {b} * {p} + 4 * {a} * {w} + 4 * {b} * {u} + {q} * {r} + 2 * {p} * {p} - 6 * {v})"
    return f"({two} / {n} / ({n} - 1) - 2 * {three} / {n} / ({n} - 1) / ({n} - 2) + {four} / {n} / ({n} - 1) / ({n} - 2) / ({n} - 3))"


def _diagonals_sql() -> str:
    by_lag = {lag: [(f"{x}{y}", x, y) for x, y in zip(NAMES, NAMES[lag:], strict=False)] for lag in range(3)}
    flat = [t for pairs in by_lag.values() for t in pairs]
    sums = ", ".join(f"sum({x}) AS a{k}, sum({y}) AS b{k}, sum({x} * {y}) AS p{k}, sum({x} * {x}) AS q{k}, sum({y} * {y}) AS r{k}, sum({x} * {x} * {y}) AS u{k}, sum({x} * {y} * {y}) AS w{k}, sum({x} * {y} * {x} * {y}) AS v{k}" for k, x, y in flat)
    z = ", ".join(f"{x} * {y} - p{k} / (s.n - 1) AS z{k}" for k, x, y in flat)
    cross = [(lag, k, m) for lag, pairs in by_lag.items() for k, *_ in pairs for m, *_ in pairs]
    fourth = ", ".join(f"sum(power({' + '.join(f'z{k} * z{k}' for k, *_ in pairs)}, 2)) AS f{lag}" for lag, pairs in by_lag.items())
    spreads = ", ".join([*(f"sum(z{k} * z{m}) AS g{k}_{m}" for _, k, m in cross), fourth])
    rows = []
    for lag, pairs in by_lag.items():
        covariance = lambda t, k: f"({t}.p{k} / {t}.n - ({t}.a{k} * {t}.b{k} - {t}.p{k}) / {t}.n / ({t}.n - 1))"
        gap = " + ".join(f"{_unbiased_square('x', k)} + {_unbiased_square('y', k)} - 2 * {covariance('x', k)} * {covariance('y', k)}" for k, *_ in pairs)
        inside = lambda t: " + ".join(f"{t}.g{k}_{m} * {t}.g{k}_{m}" for at, k, m in cross if at == lag)  # noqa: B023, E731
        own = " + ".join(f"2 * ({inside(t)} - {t}.f{lag}) / power({t}.n * ({t}.n - 1), 2)" for t in "xy")
        between = " + ".join(f"x.g{k}_{m} * y.g{k}_{m}" for at, k, m in cross if at == lag)
        rows.append(f"SELECT {lag}::BIGINT AS distance, power({gap}, 2) / ({own} + 4 * ({between}) / power(x.n * y.n, 2)) AS v FROM t x JOIN t y ON x.g = 'F' AND y.g = 'O'")
    return f"""WITH c AS ({CENTRED}), s AS (SELECT g, count(*)::DOUBLE AS n, {sums} FROM c GROUP BY g), z AS (SELECT c.g, {z} FROM c JOIN s USING (g)),
        t AS (SELECT * FROM s JOIN (SELECT g, {spreads} FROM z GROUP BY g) USING (g)) SELECT distance, round(v, 4) AS statistic FROM ({' UNION ALL '.join(rows)})"""


@query(_diagonals_sql())
def super_diagonals(spark, sf_dir):
    """Statistics of equal super-diagonals of the covariances of lines of either status."""
    found = rowtests.super_diagonal_rows(*_halves(spark, sf_dir), NAMES, 2)
    return found.select(F.col("replicate").alias("distance"), F.round("statistic", 4).alias("statistic"))
