"""Registered queries of the engine's own operators on the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import randommatrix, scalars
from tessella.operators import batch, covariance, hypothesis, imputation, joins, matrices, moments, nested, origin, querystring, reshape
from tessella.plans import completion, documents, formats, genetics, records, searching, statistics  # noqa: F401  their queries are registered when they are imported
from tessella.plans.registry import ORACLES, QUERIES, query, table
from tessella.sources import proteomics, tables
from tessella.streaming import events as ev

MEASURES = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


def variant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested annotation documents made of the tables: a part is a variant, its suppliers carry it by return flag (A: one copy, R: two,
    N: missing), its brand is the gene."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    who = lambda flag: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey").cast("string"))))
    carriers = line.groupBy("l_partkey").agg(who("A").alias("het"), who("R").alias("hom"), who("N").alias("missing"))
    one = lambda c: F.array(F.array(F.array(c.cast("string"))))
    alt = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("-"), (F.col("p_size") % 40 + 1).cast("string"))).when(F.col("p_size") % 5 == 1, "+AC").otherwise("A")
    return part.join(carriers, F.col("p_partkey") == F.col("l_partkey")).select(
        one(F.concat(F.lit("chr"), F.col("p_size") % 22 + 1)).alias("chrom"), one(F.col("p_partkey")).alias("pos"), one(F.col("p_partkey")).alias("vcfPos"), one(F.lit("G")).alias("inputRef"),
        one(alt).alias("alt"), one(F.lit("SNP")).alias("type"), one(F.col("p_name")).alias("id"), *[F.array(F.array(F.col(a))).alias(b) for a, b in (("het", "heterozygotes"), ("hom", "homozygotes"), ("missing", "missingGenos"))],
        F.struct(F.array(F.array(F.array(F.col("p_brand")), F.array(F.col("p_type")))).alias("name"), F.array(F.array(F.array(F.col("p_brand")))).alias("name2")).alias("refSeq"),
    )


def abundances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, gene, intensity: a supplier's mean price of a brand, less the brand's mean."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").cast("string").alias("SampleId"), F.col("p_brand").alias("gene")).agg(F.sum("l_extendedprice").alias("own"), F.count("*").alias("n"))
    brand = Window.partitionBy("gene")
    return own.select("SampleId", "gene", (F.col("own") / F.col("n") - F.sum("own").over(brand) / F.sum("n").over(brand)).alias("intensity"))


ALT = "CASE WHEN p_size % 5 = 0 THEN '-' || CAST(p_size % 40 + 1 AS VARCHAR) WHEN p_size % 5 = 1 THEN '+AC' ELSE 'A' END"
POSITIONS = "CASE WHEN p_size % 5 = 0 THEN least(p_size % 40 + 1, 32) WHEN p_size % 5 = 1 THEN 2 ELSE 1 END"
FLAGS = "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem"
DOSAGE = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE -1 END"


@query(f"""
    WITH f AS ({FLAGS}), p AS (SELECT *, {POSITIONS} AS n FROM part),
    own AS (SELECT l_suppkey s, p_brand g, avg(l_extendedprice) x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    ref AS (SELECT p_brand g, avg(l_extendedprice) r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT {DOSAGE} AS dosage, round(sum((x - r) * n) / sum(n), 6) AS mean_intensity, CAST(sum(n) AS BIGINT) AS n
    FROM f JOIN p ON l_partkey = p_partkey JOIN own ON own.s = l_suppkey AND own.g = p_brand JOIN ref ON ref.g = own.g GROUP BY 1""")
def flagship_dosage_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    carriers = nested.query_annotations(variant_documents(spark, sf_dir), "*", ["refSeq.name2"], exploded="refSeq.name2")
    joined = joins.join_proteomics(carriers, abundances(spark, sf_dir), protein_gene="gene", protein_sample="SampleId")
    return joined.where("intensity is not null").groupBy(F.col("dosage").cast("int").alias("dosage")).agg(F.round(F.avg("intensity"), 6).alias("mean_intensity"), F.count("*").alias("n"))


@query(f"SELECT l_partkey AS pos, CAST(l_suppkey AS VARCHAR) AS sample, {DOSAGE} AS dosage, count(*) AS n_positions FROM ({FLAGS}) JOIN (SELECT p_partkey, unnest(range({POSITIONS})) FROM part) ON l_partkey = p_partkey GROUP BY ALL")
def melt_samples(spark, sf_dir):
    rows = nested.melt_samples(nested.normalise(variant_documents(spark, sf_dir)))
    return rows.groupBy("pos", "sample", F.col("dosage").cast("int").alias("dosage")).agg(F.count("*").alias("n_positions"))


@query(f"SELECT p_partkey AS pos, {ALT} AS alt, {POSITIONS} AS n_positions FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def allele_positions(spark, sf_dir):
    return nested.normalise(variant_documents(spark, sf_dir)).groupBy("pos", "alt").agg(F.count("*").cast("int").alias("n_positions"))


@query(f"SELECT 'chr' || CAST(p_size % 22 + 1 AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR) || ':G:' || {ALT} AS locus, p_name AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def locus(spark, sf_dir):
    return nested.normalise(variant_documents(spark, sf_dir)).select("locus", "id").distinct()


@query(f"""SELECT p_partkey AS pos, unnest([p_brand, p_type]) AS name, p_brand AS name2 FROM part JOIN (SELECT p_partkey AS k, unnest(range({POSITIONS})) FROM part) ON k = p_partkey
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def explode_siblings(spark, sf_dir):
    rows = nested.explode_field(nested.normalise(variant_documents(spark, sf_dir)), "refSeq.name")
    return rows.select("pos", F.col("`refSeq.name`").alias("name"), F.get("`refSeq.name2`", F.lit(0)).alias("name2"))


def _order_lists(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("lines"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def struct_to_arrays(spark, sf_dir):
    lists = nested.struct_of_arrays(_order_lists(spark, sf_dir), "lines")
    zipped = lists.select("l_orderkey", F.arrays_zip(F.col("`lines.l_partkey`").alias("l_partkey"), F.col("`lines.l_quantity`").alias("l_quantity")).alias("z"))
    return zipped.select("l_orderkey", F.inline("z"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    q AS (SELECT DISTINCT l_orderkey, n, unnest(range(3)) AS place FROM r)
    SELECT q.l_orderkey, CAST(q.place AS INTEGER) AS place, r.l_partkey AS value FROM q LEFT JOIN r ON r.l_orderkey = q.l_orderkey AND r.i = CASE WHEN q.n = 1 THEN 0 ELSE q.place END""")
def broadcast_or_index(spark, sf_dir):
    at = _order_lists(spark, sf_dir).select("l_orderkey", F.col("lines.l_partkey").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    return at.select("l_orderkey", "place", nested.broadcast_or_index(F.col("v"), F.col("place")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND (l_quantity > 45 OR l_discount <= 0.02) AND NOT l_linestatus = 'F'")
def search_boolean(spark, sf_dir):
    return querystring.search(table(spark, sf_dir, "lineitem"), "l_returnflag:R (l_quantity:>45 || l_discount:<=0.02) !l_linestatus:F").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 20000 AND o_orderpriority LIKE '1%'")
def search_range(spark, sf_dir):
    return querystring.search(table(spark, sf_dir, "orders"), "o_totalprice:[1000 TO 20000] && o_orderpriority:1*").select("o_orderkey", "o_totalprice")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])of[^\p{L}\p{N}_]+the([^\p{L}\p{N}_]|$)') AND lang = 'en'")
def search_phrase(spark, sf_dir):
    return querystring.search(table(spark, sf_dir, "documents"), '"of the" lang:en', ["text"]).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def search_page(spark, sf_dir):
    return querystring.search_page(table(spark, sf_dir, "orders"), "o_orderstatus:O", ["o_totalprice", "o_orderkey"], 50, 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 100")
def search_after(spark, sf_dir):
    return querystring.search_after(table(spark, sf_dir, "orders"), "o_orderkey", 100, 100).select("o_orderkey", "o_custkey")


@query("SELECT CAST(least(ceil(count(*) / 10000.0), 1024) AS INTEGER) AS n_slices, count(*) AS n_docs FROM lineitem")
def slice_plan(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(querystring.plan_slices(n), n)], "n_slices int, n_docs long")


@query("SELECT p_brand AS gene_name, unnest(['size', 'price']) AS sample, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value, p_partkey FROM part")
def tmt_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene_name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return reshape.unpivot_samples(wide, ["p_partkey", "gene_name"])


@query("SELECT p_partkey, round(p_size - p_retailprice, 6) AS size, p_retailprice FROM part")
def reference_subtract(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), "p_retailprice")
    return reshape.subtract_reference(wide, ["size"], "p_retailprice").withColumn("size", F.round("size", 6))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS price, round(avg(CASE WHEN p_size % 7 <> 0 THEN p_size END), 6) AS size FROM part WHERE p_type IS NOT NULL GROUP BY p_brand")
def gene_peptide_mean(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_size")).alias("size"))
    out = reshape.gene_means(wide, "p_brand", ["price", "size"])
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("price", "size")])


@query("SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY l_suppkey")
def samples_by_genes(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return reshape.samples_by_genes(long, "l_returnflag", ["A", "N", "R"], "l_suppkey")


@query("""WITH c AS (SELECT CAST(NULLIF(c_custkey % 50, 0) AS VARCHAR) AS sample, NULLIF(c_mktsegment, 'BUILDING') AS gene, c_acctbal FROM customer),
    p AS (SELECT CAST(NULLIF(s_suppkey % 50, 0) AS VARCHAR) AS sample, CASE s_suppkey % 4 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'HOUSEHOLD' END AS gene, s_acctbal FROM supplier)
    SELECT c.sample, c.gene, c.c_acctbal, p.s_acctbal FROM c JOIN p ON c.sample IS NOT DISTINCT FROM p.sample AND c.gene IS NOT DISTINCT FROM p.gene""")
def nullsafe_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_custkey") % 50, F.lit(0)).cast("string").alias("sample"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("gene"), "c_acctbal")
    gene = F.when(F.col("s_suppkey") % 4 == 0, "AUTOMOBILE").when(F.col("s_suppkey") % 4 == 1, "MACHINERY").when(F.col("s_suppkey") % 4 == 2, "HOUSEHOLD")
    p = table(spark, sf_dir, "supplier").select(F.nullif(F.col("s_suppkey") % 50, F.lit(0)).cast("string").alias("sid"), gene.alias("target"), "s_acctbal")
    return joins.join_proteomics(c, p, "gene", "target", "sid")


@query("SELECT s_suppkey, n_name AS gene_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def id_lookup(spark, sf_dir):
    mapping = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uniprot_accession"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("gene_name"))
    return joins.lookup_genes(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", mapping).select("s_suppkey", "gene_name")


def _holes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax")).otherwise(float("nan")).alias("b"), F.col("l_discount").alias("c"))


@query("SELECT CASE WHEN l_partkey % 5 = 0 THEN '1' ELSE '0' END || CASE WHEN l_suppkey % 3 = 0 THEN '1' ELSE '0' END || '0' AS pattern, count(*) AS n_rows, min(l_orderkey) AS first_row FROM lineitem GROUP BY 1")
def missing_patterns(spark, sf_dir):
    out = reshape.missing_patterns(_holes(spark, sf_dir), ["a", "b", "c"], "l_orderkey")
    return out.withColumn("pattern", F.array_join(F.transform("pattern", lambda x: x.cast("int").cast("string")), ""))


def _fill_sql(f: str) -> str:
    v = {"mean": "avg({0}) OVER ()", "median": "median({0}) OVER ()", "zero": "0"}[f]
    a, b = "CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END", "CASE WHEN l_suppkey % 3 <> 0 THEN l_tax END"
    return f"SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce({a}, {v.format(a)}), 6) AS a, round(coalesce({b}, {v.format(b)}), 6) AS b, l_discount AS c FROM lineitem"


for _kind in ("mean", "median", "zero"):

    def _fill(spark, sf_dir, kind=_kind):
        out = imputation.fill(_holes(spark, sf_dir), ["a", "b"], kind)
        return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "c")

    QUERIES[f"fill_{_kind}"], ORACLES[f"fill_{_kind}"] = _fill, _fill_sql(_kind)


DOSES = "SELECT o_custkey AS s, o_orderkey % 40 AS j, CAST(max(CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) % 3 END) AS INTEGER) AS d FROM orders GROUP BY ALL"


@query(f"""WITH c AS (SELECT s, j, NULLIF(d, -1) AS d FROM ({DOSES})), k AS (SELECT * FROM c WHERE d IS NOT NULL),
    m AS (SELECT s, j FROM c WHERE d IS NULL), p AS (SELECT m.s, m.j, k.s AS t, k.d AS v FROM m JOIN k USING (j)),
    dist AS (SELECT p.s, p.j, p.t, p.v, (SELECT count(*) FROM k a JOIN k b ON a.j = b.j WHERE a.s = p.s AND b.s = p.t AND a.j BETWEEN p.j - 5 AND p.j + 5 AND a.d <> b.d) AS dd FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY s, j ORDER BY dd, t) AS r FROM dist), n AS (SELECT s, j, v, count(*) AS n FROM r WHERE r <= 5 GROUP BY ALL),
    w AS (SELECT s, j, v, row_number() OVER (PARTITION BY s, j ORDER BY n DESC, v) AS r FROM n)
    SELECT c.s AS sample, c.j AS variant, coalesce(c.d, w.v) AS dosage FROM c LEFT JOIN w ON w.s = c.s AND w.j = c.j AND w.r = 1""")
def knn_dosage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dose = F.max(F.when(F.col("o_orderkey") % 23 == 0, -1).otherwise(F.floor("o_totalprice") % 3)).cast("int")
    long = o.groupBy(F.col("o_custkey").alias("sample"), (F.col("o_orderkey") % 40).alias("variant")).agg(dose.alias("dosage"))
    return imputation.knn_dosage(long)


@query("SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')")
def dosage_domain(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("dosage", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(7))
    return imputation.check_dosages(line).select("l_returnflag").distinct()


@query("SELECT DISTINCT o_orderpriority AS experiment_name FROM orders")
def distinct_experiments(spark, sf_dir):
    return tables.experiment_names(table(spark, sf_dir, "orders"), "o_orderpriority")


def _centre(mode: str) -> str:
    return f"SELECT p_partkey, round(p_retailprice - {mode}(p_retailprice) OVER (PARTITION BY p_brand), 6) AS centred FROM part"


@query(_centre("median"))
def group_centre_median(spark, sf_dir):
    return origin.centre_by_group(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_centred", 6).alias("centred"))


@query(_centre("avg"))
def group_centre_mean(spark, sf_dir):
    return origin.centre_by_group(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice"], "mean").select("p_partkey", F.round("p_retailprice_centred", 6).alias("centred"))


@query("SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS mean FROM part")
def group_mean_broadcast(spark, sf_dir):
    return origin.group_means(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_mean", 6).alias("mean"))


@query("""WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - q + 0.9 * (SELECT avg(q) FROM m), 6) AS l_quantity, round(l_tax - t + 0.9 * (SELECT avg(t) FROM m), 6) AS l_tax FROM lineitem JOIN m ON g = l_returnflag""")
def mean_adaptation(spark, sf_dir):
    out = batch.mean_adaptation(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"], 0.1)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


P_SQL = "SELECT p_partkey, ((p_partkey * 7919 % m + p_partkey / (2 * m)) / m) ** 2 AS p FROM part, (SELECT max(p_partkey) * 1.0::DOUBLE AS m FROM part)"


def _p_values(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    most = float(part.agg(F.max("p_partkey")).first()[0])
    return part.select("p_partkey", F.pow((F.col("p_partkey") * 7919 % F.lit(most) + F.col("p_partkey") / F.lit(2 * most)) / F.lit(most), F.lit(2.0)).alias("p"))


@query(f"""WITH t AS ({P_SQL}), c AS (SELECT count(*) AS m, least(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) / 0.5, 1) AS pi FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS rank FROM t)
    SELECT p_partkey, CAST(rank AS INTEGER) AS rank, round(least(1, min(p * m / rank) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) * pi, 9) AS p_adjusted,
    least(1, min(p * m / rank) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) * pi <= 0.05 AS rejected FROM r, c""")
def storey_bh(spark, sf_dir):
    out = hypothesis.benjamini_hochberg(_p_values(spark, sf_dir))
    return out.select("p_partkey", "rank", F.round("p_adjusted", 9).alias("p_adjusted"), "rejected")


def _pairs_sql(value: str, where: str = "") -> str:
    parts = []
    for i, a in enumerate(MEASURES):
        for j in range(i, len(MEASURES)):
            parts.append(f"SELECT {i} AS i, {j} AS j, round({value.format(a=a, b=MEASURES[j], d=int(i == j))}, 6) AS v FROM lineitem {where}")
    return " UNION ALL ".join(parts)


@query(_pairs_sql("sum({a} * {b}) / count(*)"))
def empirical_covariance(spark, sf_dir):
    return covariance.empirical_long(table(spark, sf_dir, "lineitem"), MEASURES).withColumn("v", F.round("v", 6))


@query(_pairs_sql("(sum({a} * {b}) + {d}) / (2 + 4 + count(*) + 4 + 1)"))
def bayesian_covariance(spark, sf_dir):
    return covariance.bayesian_long(table(spark, sf_dir, "lineitem"), MEASURES).withColumn("v", F.round("v", 6))


@query(_pairs_sql("covar_samp({a}, {b})"))
def sample_covariance(spark, sf_dir):
    return covariance.sample_long(table(spark, sf_dir, "lineitem"), MEASURES).select("i", "j", F.round("v", 6).alias("v"))


@query(_pairs_sql("covar_samp({a}, {b})"))
def gram_moments(spark, sf_dir):
    """The same by partial Gram matrices in Arrow batches, which is what many columns use."""
    m = moments.moments(table(spark, sf_dir, "lineitem"), MEASURES)[None].covariance()
    return spark.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(4) for j in range(i, 4)], "i int, j int, v double")


def _scaled(c: str) -> str:
    return {"l_quantity": "(l_quantity / 15)", "l_discount": "(l_discount * 30)", "l_tax": "(l_tax * 40)"}[c]


_S = ["l_quantity", "l_discount", "l_tax"]
_TR = " + ".join(f"{1 if a == b else 2} * power(covar_samp({_scaled(a)}, {_scaled(b)}), 2)" for k, a in enumerate(_S) for b in _S[k:])
_T1 = " + ".join(f"var_samp({_scaled(a)})" for a in _S)


@query(f"""WITH t AS (SELECT count(*) AS n, {_T1} AS t1, {_TR} AS t2 FROM lineitem)
    SELECT round(n * 3 / 2.0 * ((t2 / 3) / power(t1 / 3, 2) - 1), 4) AS john, round(n * 3 / 2.0 * (t2 / 3 - 2 * t1 / 3 + 1), 4) AS nagao,
    round(n * 3 / 2.0 * ((t2 - 2 * t1 + 3) / 3 - t1 * t1 / (n * 3) + 3.0 / n), 4) AS ledoit_wolf FROM t""")
def covariance_tests(spark, sf_dir):
    scaled = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 15).alias("a"), (F.col("l_discount") * 30).alias("b"), (F.col("l_tax") * 40).alias("c"))
    m = moments.moments(scaled, ["a", "b", "c"])[None]
    row = [round(float(f(m)[0]), 4) for f in (hypothesis.john, hypothesis.nagao, hypothesis.ledoit_wolf)]
    return spark.createDataFrame([tuple(row)], "john double, nagao double, ledoit_wolf double")


@query("""WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS mq, avg(l_tax * 100) AS mt FROM lineitem GROUP BY 1),
    w AS (SELECT g, n, l_quantity - mq AS x, l_tax * 100 - mt AS y FROM lineitem JOIN g ON g = l_linestatus),
    s AS (SELECT g, n, avg(x*x) AS xx, avg(x*y) AS xy, avg(y*y) AS yy, avg(x*x*x*x) - avg(x*x)**2 AS txx, avg(x*x*y*y) - avg(x*y)**2 AS txy, avg(y*y*y*y) - avg(y*y)**2 AS tyy FROM w GROUP BY ALL),
    d AS (SELECT greatest((a.xx-b.xx)**2/(a.txx/a.n+b.txx/b.n), (a.xy-b.xy)**2/(a.txy/a.n+b.txy/b.n), (a.yy-b.yy)**2/(a.tyy/a.n+b.tyy/b.n)) AS m FROM s a JOIN s b ON a.g = 'F' AND b.g = 'O')
    SELECT round(m - 4 * ln(2) + ln(ln(2)), 5) AS stat, round(1 - exp(-exp(-(m - 4 * ln(2) + ln(ln(2))) / 2) / sqrt(8 * pi())), 5) AS p FROM d""")
def max_type_test(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", (F.col("l_tax") * 100).alias("t"))
    parts = []
    for g in ("F", "O"):
        own = line.where(F.col("l_linestatus") == g)
        means = own.agg(F.avg("l_quantity"), F.avg("t")).first()
        parts += hypothesis.product_variances(own, ["l_quantity", "t"], list(means))
    stat, p = hypothesis.clx(*parts)
    return spark.createDataFrame([(round(stat, 5), round(p, 5))], "stat double, p double")


@query("""WITH m AS (SELECT sum(l_quantity * l_quantity) / count(*) AS a, sum(l_quantity * l_tax) / count(*) AS b, sum(l_tax * l_tax) / count(*) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * b / a, 6) AS predicted_l_tax,
    round(-ln(2 * pi()) - 0.5 * ln(a * d - b * b) - 0.5 * (d * l_quantity * l_quantity - 2 * b * l_quantity * l_tax + a * l_tax * l_tax) / (a * d - b * b), 6) AS log_likelihood FROM lineitem, m""")
def gaussian_scores(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    c = covariance.fit(line, ["l_quantity", "l_tax"])
    out = c.predict(line, ["l_quantity", "l_tax"], [1, 0])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("predicted_l_tax", 6).alias("predicted_l_tax"), F.round(c.log_likelihood(["l_quantity", "l_tax"]), 6).alias("log_likelihood"))


@query(f"""WITH v AS ({" UNION ALL ".join(f"SELECT l_linestatus AS g, {i} AS i, {j} AS j, sum({a} * {b}) / count(*) AS v FROM lineitem GROUP BY 1" for i, a in enumerate(_S) for j, b in enumerate(_S))})
    SELECT round(sqrt(sum((a.v - b.v) ** 2)), 6) AS frobenius, round(sum((a.v - b.v) ** 2), 6) AS mahalanobis FROM v a JOIN v b ON a.i = b.i AND a.j = b.j AND a.g = 'F' AND b.g = 'O'""")
def frobenius_loss(spark, sf_dir):
    long = covariance.empirical_long(table(spark, sf_dir, "lineitem"), _S, ["l_linestatus"])
    one = lambda g: moments.mirrored(long.where(F.col("l_linestatus") == g).select("i", "j", "v")).withColumn("matrix_id", F.lit(0))
    out = matrices.frobenius_long(joins.match_matrices(one("F"), one("O")))
    return out.select(F.round("frobenius", 6).alias("frobenius"), F.round("mahalanobis", 6).alias("mahalanobis"))


@query("SELECT p_partkey, round(CASE WHEN x > 0.25 AND x < 2.25 THEN 4 / (2 * pi() * x) * sqrt((x - 0.25) * (2.25 - x)) ELSE 0 END, 9) AS density FROM (SELECT p_partkey, p_size / 20.0 AS x FROM part)")
def mp_density(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 20.0).alias("x"))
    return x.select("p_partkey", F.round(randommatrix.mp_density(F.col("x"), 4.0), 9).alias("density"))


@query("SELECT p_partkey, round(power(sqrt(n - 0.5) + sqrt(p - 0.5), 2) / n, 9) AS centre, round((sqrt(n - 0.5) + sqrt(p - 0.5)) * cbrt(1 / sqrt(n - 0.5) + 1 / sqrt(p - 0.5)) / n, 9) AS scale FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p, CAST(p_partkey + 5 AS DOUBLE) AS n FROM part)")
def wishart_parameters(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p"), (F.col("p_partkey") + 5).cast("double").alias("n"))
    centre, scale = randommatrix.wishart_max_parameters(F.col("n"), F.col("p"))
    return x.select("p_partkey", F.round(centre, 9).alias("centre"), F.round(scale, 9).alias("scale"))


@query("""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - q) * 0.5 + (l_tax - t) * -2.0, 9) > 0 AS called FROM lineitem, m""")
def parent_calls(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    means = [float(v) for v in line.agg(F.avg("l_quantity"), F.avg("l_tax")).first()]
    return line.select("l_orderkey", "l_linenumber", "l_partkey", origin.call_parent(["l_quantity", "l_tax"], means, [0.5, -2.0]).alias("called"))


@query(None)
def parent_effects(spark, sf_dir):
    """Parent-of-origin effects of many variants: suppliers are variants, the return flag is the genotype."""
    line = table(spark, sf_dir, "lineitem").withColumn("genotype", F.when(F.col("l_returnflag") == "A", 0).otherwise(1))
    return origin.many_variants(line, "l_suppkey", "genotype", ["l_quantity", "l_discount", "l_tax"])


@query(None)
def rotation_adaptation(spark, sf_dir):
    return batch.rotation_adaptation(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax"), "l_returnflag", ["l_quantity", "l_tax"])


@query("""WITH d AS (SELECT doc_id, text, greatest(CAST(ceil(length(text) / 1000.0) AS INTEGER), 1) AS n FROM documents), c AS (SELECT *, unnest(range(n)) AS part FROM d)
    SELECT doc_id, CAST(part AS INTEGER) AS part, n AS n_parts, CAST(part * 1000 AS INTEGER) AS start, sha256(substring(text, CAST(part * 1000 + 1 AS BIGINT), 1000)) AS sha256 FROM c""")
def chunk_plan(spark, sf_dir):
    return tables.chunk_plan(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > count(*) OVER (PARTITION BY user_id) - 5")
def bounded_history(spark, sf_dir):
    return ev.bounded_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) WHERE s > 10")
def replay_after(spark, sf_dir):
    return ev.replay_after(ev.bounded_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 1 << 30), 10).select("event_id")


@query("SELECT user_id, min(event_id) AS position, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_messages(spark, sf_dir):
    return ev.upsert_messages(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


SNAPSHOTS = """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN text ELSE string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS text FROM conversations"""


@query(f"""WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS old FROM ({SNAPSHOTS}))
    SELECT conv_id, turn, CASE WHEN starts_with(text, old) THEN 'append' ELSE 'replace' END AS change, CASE WHEN starts_with(text, old) THEN substring(text, length(old) + 1) ELSE text END AS delta FROM p WHERE NOT starts_with(text, old) OR length(text) > length(old)""")
def delta_append_replace(spark, sf_dir):
    """Snapshots that grow by a conversation's whole texts, every fourth one being replaced by its own text."""
    grown = F.array_join(F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)), "\n")
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(grown))
    return ev.deltas(rows, ["conv_id"], "turn", "text").select("conv_id", "turn", "change", "delta")


@query("""WITH u AS (SELECT conv_id, max(turn) AS u FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT c.conv_id, max(c.turn) AS turn, arg_max(c.text, c.turn) AS text FROM conversations c LEFT JOIN u USING (conv_id) WHERE role = 'assistant' AND (u IS NULL OR turn > u) GROUP BY 1""")
def latest_final_per_turn(spark, sf_dir):
    return ev.latest_after_user(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", F.col("role") == "assistant").select("conv_id", "turn", "text")


@query("""SELECT event_id, k FROM (SELECT event_id, k, max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events)) WHERE best IS NULL OR k >= best""")
def checkpoint_monotone(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ev.monotone_checkpoints(rows, "user_id", "event_id", "k").select("event_id", "k")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ev.event_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", ["event_type"]).select("start", "event_type", "n")


@query("SELECT event_id, round(least(1, value / 50), 9) AS fraction, CASE WHEN event_id % 3 IN (0, 2) THEN 'Homozygote' ELSE 'Heterozygote' END AS zygosity, round(0.01 * power(10 + event_id, -0.55), 12) AS step, split_part('a.b.' || event_type, '.', 3) AS last FROM events")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(scalars.fraction_done(F.col("value"), F.lit(50.0)), 9).alias("fraction"), scalars.zygosity(F.col("event_id") % 3).alias("zygosity"), F.round(scalars.sgld_step(F.col("event_id"), 0.01, 10.0), 12).alias("step"), scalars.last_part(F.concat(F.lit("a.b."), "event_type")).alias("last"))


@query("""WITH h AS (SELECT c_custkey, sha256('run/' || c_name) AS h FROM customer) SELECT c_custkey, substr(h,1,8) || '-' || substr(h,9,4) || '-4' || substr(h,14,3) || '-' ||
    substr('89ab', CAST((strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id FROM h""")
def stable_uuids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.stable_uuid(F.lit("run"), F.col("c_name")).alias("id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, i, j, round(v, 6) AS v FROM (SELECT *, unnest([0,0,1]) AS i, unnest([0,1,1]) AS j, unnest([l_quantity*l_quantity, l_quantity*l_tax, l_tax*l_tax]) AS v FROM lineitem)")
def upper_products(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"), "l_quantity", "l_tax")
    return reshape.upper_products(line, "k", ["l_quantity", "l_tax"]).select("k.*", "i", "j", F.round("v", 6).alias("v"))


@query("SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 5")
def union_slices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return s.unionByName(s.where("s_nationkey < 5")).drop("s_nationkey")


@query("SELECT p_brand, median(p_retailprice) AS median, round(quantile_cont(p_retailprice, 0.95), 6) AS q95, round(var_pop(p_retailprice), 4) AS var_pop, round(var_samp(p_retailprice), 4) AS var_samp FROM part GROUP BY 1")
def group_statistics(spark, sf_dir):
    out = reshape.group_statistics(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 0.95)
    return out.select("p_brand", "median", F.round("quantile", 6).alias("q95"), F.round("var_pop", 4).alias("var_pop"), F.round("var_samp", 4).alias("var_samp"))


@query("SELECT event_id, round(sqrt(var_pop(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 6) AS growing_std, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING), 6) AS rolling_mean FROM events")
def moving_statistics(spark, sf_dir):
    out = reshape.moving_statistics(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 3)
    return out.select("event_id", F.round("growing_std", 6).alias("growing_std"), F.round("rolling_mean", 6).alias("rolling_mean"))


@query("SELECT n_nationkey, {'n_name': n_name, 'n_regionkey': n_regionkey}.n_name AS n_name FROM nation")
def table_json(spark, sf_dir):
    schema, rows = proteomics.to_table_json(table(spark, sf_dir, "nation"))
    return proteomics.from_table_json(schema, rows).select("n_nationkey", "n_name")
