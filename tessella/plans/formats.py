"""Registered queries that write the tables in the proteomics file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import query, table
from tessella.sources import adat, proteomics, tables
from tessella.sources.scratch import new_folder

FLAGS = ["A", "N", "R"]
#: Quantities of each part by return flag, missing where no line has the flag.
BY_FLAG = "SELECT p_partkey, any_value(p_brand) AS brand, any_value(p_name) AS name, any_value(p_size) AS size, any_value(p_retailprice) / 100 AS reference, " + ", ".join(
    f"sum(l_quantity) FILTER (l_returnflag = '{f}') AS {f.lower()}" for f in FLAGS
)
BY_FLAG += " FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey"


def _by_flag(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f"run_{f}") for f in FLAGS])
    part = table(spark, sf_dir, "part").withColumn("ReferenceIntensity", F.col("p_retailprice") / 100)
    return part.join(sums, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("Index", F.concat(F.lit("P"), F.col("p_partkey")))


def _written(spark, df, name: str) -> str:
    path = new_folder(spark, name)
    tables.write_delimited(df, path)
    return path


RUNS = [f"run_{f}" for f in FLAGS]


@query(f"""WITH w AS ({BY_FLAG}) SELECT 'P' || p_partkey AS gene_name, CAST(size AS DOUBLE) AS n_psm, brand AS protein, flag AS sample_name, 'returned ' || flag AS condition, round(v - reference, 4) AS value
    FROM (SELECT *, unnest(['A', 'N', 'R']) AS flag, unnest([a, n, r]) AS v FROM w)""")
def tmt_files(spark, sf_dir):
    """A TMT abundance matrix and its annotation, written, read, melted and joined."""
    wide = _by_flag(spark, sf_dir).select("Index", F.col("p_size").alias("NumberPSM"), F.col("p_brand").alias("ProteinID"), F.lit(0.99).alias("MaxPepProb"), "ReferenceIntensity", *RUNS)
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    name = F.col("l_returnflag")
    annotation = flags.select(F.lit(1).alias("plex"), F.concat(F.lit("126"), name).alias("channel"), F.concat(F.lit("run_"), name).alias("sample"), name.alias("sample_name"), F.concat(F.lit("returned "), name).alias("condition"), F.lit(1).alias("replicate"))
    data = proteomics.read_tmt(spark, _written(spark, wide, "tmt"), _written(spark, annotation, "tmt-annotation"))
    long = data.melt().join(data.annotation, "sample")
    return long.select("gene_name", F.col("NumberPSM").alias("n_psm"), F.col("ProteinID").alias("protein"), "sample_name", "condition", F.round("normalized_sample_intensity", 4).alias("value"))


@query(f"WITH w AS ({BY_FLAG}) SELECT 'P' || p_partkey AS protein, unnest(['run_A', 'run_N', 'run_R']) AS sample, round(unnest([a, n, r]), 4) AS value FROM w")
def dia_file(spark, sf_dir):
    """A DIA matrix of protein groups, written and read; names, genes and descriptions go."""
    wide = _by_flag(spark, sf_dir).select(
        F.concat(F.lit("G"), F.col("p_partkey")).alias("Protein.Group"), F.col("Index").alias("Protein.Ids"), F.col("p_name").alias("Protein.Names"), F.col("p_brand").alias("Genes"), F.col("p_type").alias("First.Protein.Description"), *RUNS
    )
    data = proteomics.read_dia(spark, _written(spark, wide, "dia"))
    return proteomics.unpivot_samples(data.abundance, ["Protein.Ids"]).select(F.col("`Protein.Ids`").alias("protein"), "sample", F.round("value", 4).alias("value"))


@query(f"""WITH w AS ({BY_FLAG}), l AS (SELECT *, unnest(['run_A', 'run_N', 'run_R']) AS sample, unnest([a, n, r]) - reference AS v FROM w)
    SELECT 'gene' AS level, 'P' || p_partkey AS gene, sample, round(v, 4) AS value FROM l UNION ALL SELECT 'peptide', brand, sample, round(avg(v), 4) FROM l GROUP BY brand, sample""")
def fragpipe_files(spark, sf_dir):
    """A gene-level and a peptide-level matrix, told apart by their columns; peptides are averaged by gene."""
    wide = _by_flag(spark, sf_dir)
    genes = wide.select("Index", F.col("p_size").alias("NumberPSM"), F.col("p_brand").alias("Proteins"), "ReferenceIntensity", *RUNS)
    peptides = wide.select("Index", F.col("p_brand").alias("Gene"), F.col("p_name").alias("Peptide"), "ReferenceIntensity", *RUNS)
    read = {level: proteomics.read_fragpipe(spark, _written(spark, df, f"fragpipe-{level}")) for level, df in (("gene", genes), ("peptide", peptides))}
    both = read["gene"].withColumn("level", F.lit("gene")).unionByName(read["peptide"].withColumn("level", F.lit("peptide")))
    return both.select("level", "gene", "sample", F.round("value", 4).alias("value"))


@query("""WITH v AS (SELECT l_suppkey AS s, p_brand AS b, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT CAST(s_suppkey AS VARCHAR) AS SampleId, s_name AS SampleName, b AS Target, n AS Parts, round(q, 4) AS RFU FROM supplier CROSS JOIN (SELECT p_brand AS b, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1) t
    LEFT JOIN v USING (b) WHERE v.s = s_suppkey UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, b, n, NULL FROM supplier CROSS JOIN (SELECT p_brand AS b, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1) t
    WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.b = t.b AND v.s = s_suppkey)""")
def adat_files(spark, sf_dir):
    """Suppliers and brands as a folder of ADAT files, written and read in byte ranges; pairs without lines are missing values."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.count("*").alias("Parts"))
    analytes = brands.select(F.col("p_brand").alias("column_id"), F.col("p_brand").alias("Target"), "Parts")
    samples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_suppkey").alias("SampleId"), F.col("s_name").alias("SampleName"))
    rfu = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("row_id"), F.col("p_brand").alias("column_id")).agg(F.sum("l_quantity").alias("RFU"))
    path = new_folder(spark, "adat")
    adat.write_adat(proteomics.SomascanDataset(samples, analytes, rfu), path)
    read = adat.read_adat_ranges(spark, path).melt()
    return read.select("SampleId", "SampleName", "Target", "Parts", F.round("RFU", 4).alias("RFU"))
