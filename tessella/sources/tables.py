"""Other sources and sinks: covariates, identifier mappings, VCF text, chunk plans, upload validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COVARIATES = ("sample_id", "subject_id", "sex", "population", "superpopulation")
COVARIATE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COVARIATES])


def covariates(df: DataFrame) -> DataFrame:
    """The known covariate columns, under lower-case names, null where the file lacks them; unknown columns are left out.

    A file without sample_id raises ValueError; a row without one fails when read.
    """
    names = {c.lower().strip(): c for c in df.columns}
    if "sample_id" not in names:
        raise ValueError("sample_id is required")
    columns = [F.col(f"`{names[c]}`").cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in COVARIATES]
    blank = F.coalesce(F.length(F.trim(F.col("sample_id"))), F.lit(0)) == 0
    return df.select(*columns).withColumn("sample_id", F.when(blank, F.raise_error(F.lit("sample_id is empty"))).otherwise(F.col("sample_id")))


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    return covariates(spark.read.option("sep", "\t").option("header", True).csv(path))


def read_gene_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("uniprot_accession string, gene_name string").csv(path)


def gene_mapping(entries: DataFrame) -> DataFrame:
    """uniprot_accession, gene_name from accession and a list of genes, each with a list of names; accessions without names go."""
    names = entries.select("accession", F.explode("genes").alias("g")).select("accession", F.explode("g.names").alias("gene_name"))
    return names.where("gene_name is not null").select(F.col("accession").alias("uniprot_accession"), "gene_name")


def simulate_vcf(spark: SparkSession, n_variants: int, n_samples: int, seed: int = 0) -> DataFrame:
    """Random variants: seeded columns, one row each, made on the executors."""
    base = lambda k: F.element_at(F.array(*map(F.lit, "ACGT")), (F.rand(seed + k) * 4).cast("int") + 1)
    ref = spark.range(n_variants).select((F.rand(seed) * 22 + 1).cast("int").alias("#CHROM"), (F.rand(seed + 1) * 1_000_000 + 1).cast("int").alias("POS"), base(2).alias("REF"), base(3).alias("other"), (F.rand(seed + 4) * 100).cast("int").alias("QUAL"))
    shift = F.translate("REF", "ACGT", "CGTA")
    alt = F.when(F.col("other") == F.col("REF"), shift).otherwise(F.col("other"))
    call = lambda k: F.element_at(F.array(*map(F.lit, ("0|0", "0|1", "1|0", "1|1"))), (F.rand(seed + 10 + k) * 4).cast("int") + 1)
    return ref.withColumn("ALT", alt).select(
        "#CHROM", "POS", F.concat_ws(":", "#CHROM", "POS", "REF", "ALT").alias("ID"), "REF", "ALT", "QUAL", F.lit("PASS").alias("FILTER"), F.lit(".").alias("INFO"), F.lit("GT").alias("FORMAT"), *[call(k).alias(f"SampleID{k + 1}") for k in range(n_samples)]
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF text to columns named by its #CHROM line; lines of ## are left out. gzip files are read as they are."""
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM line")
    names = head["value"].lstrip("#").split("\t")
    cells = F.split("value", "\t")
    types = {"POS": "long", "QUAL": "double"}
    return lines.where(~F.col("value").startswith("#")).select(*[F.get(cells, F.lit(k)).try_cast(types.get(c, "string")).alias(c) for k, c in enumerate(names)])


def write_vcf(df: DataFrame, path: str, comments: list[str] = ()) -> None:
    """gzip-compressed text lines; comments and the line of column names are a part file of their own."""
    head = [(f"##{c}",) for c in comments] + [("\t".join(df.columns),)]
    df.sparkSession.createDataFrame(head, "value string").coalesce(1).write.mode("append").option("compression", "gzip").text(path)
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(".")) for c in df.columns])).write.mode("append").option("compression", "gzip").text(path)


def write_delimited(df: DataFrame, path: str, separator: str = "\t", missing: str = "") -> None:
    """gzip-compressed text with a header in each part file: tab-separated, or comma-separated with separator ','."""
    df.write.mode("overwrite").option("compression", "gzip").option("sep", separator).option("header", True).option("nullValue", missing).csv(path)


def genotypes_long(vcf: DataFrame, samples: list[str]) -> DataFrame:
    """ID, sample, dosage: alternate alleles of each genotype, null where one is missing."""
    pairs = vcf.unpivot(["ID"], [F.col(f"`{s}`") for s in samples], "sample", "gt")
    alleles = F.split(F.element_at(F.split("gt", ":"), 1), r"[|/]")
    return pairs.select("ID", "sample", F.when(F.exists(alleles, lambda a: a == "."), None).otherwise(F.aggregate(alleles, F.lit(0), lambda n, a: n + (a != "0").cast("int"))).alias("dosage"))


def chunk_plan(blobs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Upload chunks of a text: id, part (from 0), n_parts = ceil(length / chunk), start, sha256 of the chunk. Sizes are in characters."""
    n = F.greatest(F.ceil(F.length(text_col) / chunk).cast("int"), F.lit(1))
    parts = blobs.select(id_col, text_col, n.alias("n_parts")).select(id_col, text_col, "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    start = F.col("part") * chunk
    return parts.select(id_col, "part", "n_parts", start.alias("start"), F.sha2(F.substring(F.col(text_col), (start + 1).cast("int"), F.lit(chunk)).cast("binary"), 256).alias("sha256"))


def retry_delay(attempt):
    """Seconds before a retry: powers of two up to 15."""
    return F.least(F.lit(15.0), F.pow(F.lit(2.0), attempt))


def retryable(status):
    """Whether an HTTP status is worth another try: 408, 429 and all of 5xx."""
    return status.isin(408, 429) | ((status >= 500) & (status < 600))


def experiment_names(df: DataFrame, column: str = "Experiment Name") -> DataFrame:
    """Distinct names of an upload's experiments, taken from the column of that name wherever it stands."""
    return df.select(F.col(f"`{column}`").alias("experiment_name")).where("experiment_name is not null").distinct()


def validate_upload(df: DataFrame, required: tuple[str, ...] = ("Experiment Name", "Subject ID", "Sample ID"), name: str | None = None) -> str:
    """The name of the upload's experiment; ValueError if a column is missing, or if there are several names and none was given."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    names = [r[0] for r in experiment_names(df).limit(2).collect()]
    if name is None and len(names) != 1:
        raise ValueError("the file has several experiments; name one" if names else "the file names no experiment")
    return name or names[0]
