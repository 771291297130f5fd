"""Readers of protein abundance files and the dataset classes around them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.reshape import gene_means, has_prefix, subtract_reference, unpivot_samples

#: Leading columns of the file formats.
TMT_COLUMNS = ["Index", "NumberPSM", "ProteinID", "MaxPepProb", "ReferenceIntensity"]
TMT_ANNOTATION = ["plex", "channel", "sample", "sample_name", "condition", "replicate"]
DIA_COLUMNS = ["Protein.Group", "Protein.Ids", "Protein.Names", "Genes", "First.Protein.Description"]
PEPTIDE_COLUMNS = ["Index", "Gene", "Peptide", "ReferenceIntensity"]
GENE_COLUMNS = ["Index", "NumberPSM", "Proteins", "ReferenceIntensity"]


def read_tsv(spark: SparkSession, path: str, text: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated file with a header; columns are doubles but for those named. One line is read to learn the header."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in header])
    return spark.read.option("sep", "\t").option("header", True).option("nanValue", "NaN").schema(schema).csv(path)


def _check(df: DataFrame, expected: list[str]) -> None:
    if not has_prefix(df, expected):
        raise ValueError(f"columns must start with {expected}, found {df.columns[: len(expected)]}")


@dataclass
class TandemMassTagDataset:
    """Gene-level TMT abundances, normalised to the reference intensity, and the annotation of their samples."""

    abundance: DataFrame
    annotation: DataFrame

    def __post_init__(self):
        _check(self.abundance, ["gene_name", *TMT_COLUMNS[1:]])
        _check(self.annotation, TMT_ANNOTATION)

    def melt(self) -> DataFrame:
        return unpivot_samples(self.abundance, ["gene_name", *TMT_COLUMNS[1:]], "sample", "normalized_sample_intensity")


def prepare_tmt(abundance: DataFrame, annotation: DataFrame) -> TandemMassTagDataset:
    """Samples less the reference intensity, which stays; Index becomes gene_name."""
    _check(abundance, TMT_COLUMNS)
    samples = abundance.columns[len(TMT_COLUMNS) :]
    return TandemMassTagDataset(subtract_reference(abundance, samples).withColumnRenamed("Index", "gene_name"), annotation)


def read_tmt(spark: SparkSession, abundance_path: str, annotation_path: str) -> TandemMassTagDataset:
    annotation = read_tsv(spark, annotation_path, ("channel", "sample", "sample_name", "condition"))
    return prepare_tmt(read_tsv(spark, abundance_path, ("Index", "ProteinID")), annotation)


@dataclass
class DataIndependentDataset:
    """DIA protein groups by Protein.Ids, one column per run."""

    abundance: DataFrame
    annotation: DataFrame | None = None


def read_dia(spark: SparkSession, path: str, annotation_path: str | None = None) -> DataIndependentDataset:
    wide = read_tsv(spark, path, tuple(DIA_COLUMNS))
    _check(wide, DIA_COLUMNS)
    annotation = read_tsv(spark, annotation_path, ("sample", "sample_name", "condition")) if annotation_path else None
    return DataIndependentDataset(wide.drop(*[c for c in DIA_COLUMNS if c != "Protein.Ids"]), annotation)


def normalise_fragpipe(wide: DataFrame) -> DataFrame:
    """Long gene, sample, value of a peptide-level or gene-level matrix, told apart by its leading columns, less the reference."""
    if wide.columns[:4] == PEPTIDE_COLUMNS:
        samples = wide.columns[4:]
        genes = gene_means(subtract_reference(wide, samples, keep=False), "Gene", samples).withColumnRenamed("Gene", "gene")
    elif wide.columns[:4] == GENE_COLUMNS:
        samples = wide.columns[4:]
        genes = subtract_reference(wide, samples, keep=False).select(F.col("Index").alias("gene"), *[F.col(f"`{c}`") for c in samples])
    else:
        raise ValueError("Dataset format not recognized")
    return unpivot_samples(genes, ["gene"])


def read_fragpipe(spark: SparkSession, path: str) -> DataFrame:
    return normalise_fragpipe(read_tsv(spark, path, ("Index", "Gene", "Peptide", "Proteins")))


@dataclass
class SomascanDataset:
    """A SomaScan matrix as three tables: samples (row_id and its fields), analytes (column_id and its fields), rfu (row_id, column_id, RFU)."""

    samples: DataFrame
    analytes: DataFrame
    rfu: DataFrame

    def melt(self) -> DataFrame:
        """One row per sample and analyte with all their fields. Analytes number a few thousand whatever the study, so their side may be broadcast."""
        return self.rfu.join(self.samples, "row_id").join(self.analytes, "column_id").drop("row_id", "column_id")


def read_adat(spark: SparkSession, path: str) -> SomascanDataset:
    """An ADAT text file: ^HEADER, ^COL_DATA and ^ROW_DATA lines, then ^TABLE_BEGIN, a block of analyte fields (one per line, shifted
    right past the sample fields), the line of sample field names, and one line per sample."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("cells", F.split("value", "\t"))
    begin = lines.where(F.col("value").startswith("^TABLE_BEGIN")).agg(F.min("at")).first()[0]
    if begin is None:
        raise ValueError("no ^TABLE_BEGIN in the file")
    body = lines.where(F.col("at") > begin).where(F.length(F.trim("value")) > 0)
    first = body.where(F.col("cells")[0] != "").orderBy("at").first()
    head = body.where(F.col("at") < first["at"]).orderBy("at").collect()  # the analyte fields: some tens of lines
    names = [c for c in first["cells"] if c]
    gap = next(i for i, c in enumerate(head[0]["cells"]) if c)
    fields = [r["cells"][gap] for r in head]
    columns = [r["cells"][gap + 1 :] for r in head]
    rows = [(j, *(col[j] if j < len(col) else None for col in columns)) for j in range(max(map(len, columns), default=0))]
    analytes = spark.createDataFrame(rows, T.StructType([T.StructField("column_id", T.IntegerType()), *(T.StructField(f, T.StringType()) for f in fields)]))
    data = body.where(F.col("at") > first["at"]).withColumnRenamed("at", "row_id")
    samples = data.select("row_id", *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(names)])
    values = F.slice("cells", gap + 2, F.greatest(F.size("cells") - (gap + 1), F.lit(0)))
    rfu = data.select("row_id", F.posexplode(values).alias("column_id", "text")).select("row_id", "column_id", F.col("text").try_cast("double").alias("RFU"))
    return SomascanDataset(samples, analytes, rfu)


def to_table_json(df: DataFrame) -> tuple[str, DataFrame]:
    """A table as its schema (JSON text) and one JSON document per row."""
    return df.schema.json(), df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row"))


def from_table_json(schema: str, rows: DataFrame) -> DataFrame:
    """The table back; rows that don't parse raise an error when read."""
    kind = T.StructType.fromJson(json.loads(schema))
    return rows.select(F.from_json("row", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
