"""Registered queries of packed genotypes and of joins with hot keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import genotypes, gradients, joins, skew
from tessella.plans.registry import query, table

DOSAGES = "SELECT l_partkey AS v, l_suppkey AS s, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END) AS g FROM lineitem GROUP BY ALL"


def _packed(spark, sf_dir):
    """Parts are variants, suppliers samples with two phenotypes; packing takes the largest dosage of a pair."""
    dose = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("g")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("s"), dose)
    samples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), "s_acctbal", "s_nationkey")
    return genotypes.pack_genotypes(rows, samples, "v", "s", "g", ["s_acctbal", "s_nationkey"])


@query(f"""SELECT v, g AS genotype, count(*) AS n, round(avg(s_acctbal) + 1e-7, 4) AS mean_balance, round(avg(s_nationkey) + 1e-7, 4) AS mean_nation,
    round(covar_pop(s_acctbal, s_nationkey) + 1e-6, 3) AS covariance FROM ({DOSAGES}) JOIN supplier ON s = s_suppkey GROUP BY ALL""")
def packed_genotype_moments(spark, sf_dir):
    found = genotypes.packed_moments(_packed(spark, sf_dir))
    return found.select("v", "genotype", "n", F.round(F.col("mean")[0] + 1e-7, 4).alias("mean_balance"), F.round(F.col("mean")[1] + 1e-7, 4).alias("mean_nation"), F.round(F.col("covariance")[1] + 1e-6, 3).alias("covariance"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS sample, p_brand AS gene, CAST(n AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN (SELECT l_returnflag AS f, p_brand AS b, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY ALL) ON f = l_returnflag AND b = p_brand""")
def split_abundance_join(spark, sf_dir):
    """The abundance join with hot keys split: return flags and brands are few, so every key is hot."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("sample"), "gene", "l_linestatus")
    counts = rows.where("l_linestatus = 'F'").groupBy(F.col("sample").alias("who"), F.col("gene").alias("what")).agg(F.count("*").alias("n"))
    return joins.join_proteomics(rows.drop("l_linestatus"), counts, "gene", "what", "who", split_hot=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS l_quantity_mean FROM lineitem")
def split_group_means(spark, sf_dir):
    """Means of three large groups, joined back with each group split."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    out = skew.with_group_means(line, "l_returnflag", ["l_quantity"], measure=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity_mean", 6).alias("l_quantity_mean"))


@query("""WITH t AS (SELECT l_discount * 10 AS x, l_tax * 10 AS z, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
    s AS (SELECT count(*) AS n, sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS d, avg(x * (0.5 - y)) AS gx, avg(z * (0.5 - y)) AS gz, avg(0.5 - y) AS g FROM t),
    k AS (SELECT *, 2 * n / ((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) AS step FROM s),
    w AS (SELECT *, sign(-gx) * greatest(abs(step * gx) - step * 0.01, 0) AS wx, sign(-gz) * greatest(abs(step * gz) - step * 0.01, 0) AS wz FROM k)
    SELECT round(wx * greatest(1 - step * 0.02 / sqrt(wx * wx + wz * wz), 0), 6) AS x, round(wz * greatest(1 - step * 0.02 / sqrt(wx * wx + wz * wz), 0), 6) AS z, round(-0.5 * g, 6) AS bias FROM w""")
def logistic_step(spark, sf_dir):
    """The first proximal step of the reduced-rank logistic model over all lines."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("z"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    w, b = gradients.reduced_rank_logistic_rows(line, ["x", "z"], ["y"], l1=0.01, nuclear=0.02, rounds=1)
    return spark.createDataFrame([(round(float(w[0, 0]), 6), round(float(w[1, 0]), 6), round(float(b[0]), 6))], "x double, z double, bias double")
