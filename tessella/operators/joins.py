"""Annotation rows to protein abundances, identifier look-ups, binding by row id, matching of lists of matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import split_join
from tessella.sources.proteomics import SomascanDataset, TandemMassTagDataset

ColumnFn = Callable[[Column], Column]


def join_proteomics(
    variants: DataFrame,
    proteins: DataFrame | TandemMassTagDataset | SomascanDataset,
    variant_gene: str = "refSeq.name2",
    protein_gene: str | None = None,
    protein_sample: str | None = None,
    map_variant_sample: ColumnFn | None = None,
    map_protein_sample: ColumnFn | None = None,
    split_hot: bool | None = None,
) -> DataFrame:
    """Inner join of variant carriers to protein abundances on sample and gene; null keys match null keys.

    TMT data is melted and joined on gene_name and sample, SomaScan data on Target and SampleId; a plain DataFrame needs both names.
    The protein side's sample and gene columns go if they are named otherwise than the variant side's; other names on both
    sides get _x and _y. Identifiers may be mapped by Column functions first. Neither input is changed. Hot keys of the variant side, null keys
    among them, are measured and split if it is large (split_hot: always or never).
    """
    if isinstance(proteins, TandemMassTagDataset):
        right, gene, sample = proteins.melt(), protein_gene or "gene_name", protein_sample or "sample"
    elif isinstance(proteins, SomascanDataset):
        right, gene, sample = proteins.melt(), protein_gene or "Target", protein_sample or "SampleId"
    else:
        if protein_gene is None or protein_sample is None:
            raise ValueError("a DataFrame needs protein_gene and protein_sample")
        right, gene, sample = proteins, protein_gene, protein_sample
    left = variants
    if map_variant_sample:
        left = left.withColumn("sample", map_variant_sample(F.col("sample")))
    if map_protein_sample:
        right = right.withColumn(sample, map_protein_sample(F.col(f"`{sample}`")))
    drop = {sample, gene}  # equal to the variant side's columns after the join
    both = {c for c in left.columns if c in right.columns and c not in ("sample", variant_gene) and c not in drop}
    # numbered names, since both sides may have columns of the same name
    x = left.select(*[F.col(f"`{c}`").alias(f"__l{k}") for k, c in enumerate(left.columns)])
    y = right.select(*[F.col(f"`{c}`").alias(f"__r{k}") for k, c in enumerate(right.columns)])
    l_cols = [F.col(f"__l{k}").alias(f"{c}_x" if c in both else c) for k, c in enumerate(left.columns)]
    r_cols = [F.col(f"__r{k}").alias(f"{c}_y" if c in both else c) for k, c in enumerate(right.columns) if c not in drop]
    at = lambda df, c, side: f"__{side}{[x.lower() for x in df.columns].index(c.lower())}"
    on = [(at(left, "sample", "l"), at(right, sample, "r")), (at(left, variant_gene, "l"), at(right, gene, "r"))]
    return split_join(x, y, on, measure=split_hot).select(*l_cols, *r_cols)


def _looked_up(ids: DataFrame, column: str, known: DataFrame, value: str, strict: bool) -> DataFrame:
    """Join to known (__key, value); strict: reading an id that known lacks raises an error."""
    if not strict:
        return ids.join(known, F.col(f"`{column}`") == F.col("__key"), "inner").drop("__key")
    found = ids.join(known, F.col(f"`{column}`") == F.col("__key"), "left")
    unknown = F.raise_error(F.concat(F.lit(f"{column} is not in the mapping: "), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))))
    return found.withColumn(value, F.when(F.col("__key").isNull(), unknown).otherwise(F.col(value))).drop("__key")


def lookup_genes(ids: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """Gene names of UniProt accessions (mapping: uniprot_accession, gene_name). An accession without a name, or that the mapping lacks, is left
    out; strict: the first is left out, the second raises an error when read."""
    known = mapping.select(F.col("uniprot_accession").alias("__key"), "gene_name")
    if not strict:
        known = known.where("gene_name is not null")
    out = _looked_up(ids, column, known, "gene_name", strict)
    return out.where("gene_name is not null") if strict else out


def lookup_proteins(genes: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """UniProt accessions of gene names, null accessions kept; strict: a name that the mapping lacks raises an error when read."""
    return _looked_up(genes, column, mapping.select(F.col("gene_name").alias("__key"), "uniprot_accession"), "uniprot_accession", strict)


def unknown_ids(ids: DataFrame, column: str, mapping: DataFrame, key: str) -> DataFrame:
    """Identifiers that a mapping lacks; a look-up that must be complete fails if there are any."""
    return ids.join(mapping, F.col(f"`{column}`") == F.col(f"`{key}`"), "left_anti").select(column).distinct()


def bind_columns(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Columns of two tables side by side; rows have no order, so an id says which belong together."""
    return left.join(right, row_id, "inner")


def match_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of long matrices (matrix_id, i, j, v) by matrix_id; a list of one is paired with every matrix of the other.

    Returns matrix_id, i, j, a, b. Raises ValueError if both lists have several matrices and differ in number.
    """
    n_a, n_b = (x.agg(F.countDistinct("matrix_id")).first()[0] for x in (a, b))
    if n_a != n_b and 1 not in (n_a, n_b):
        raise ValueError(f"{n_a} matrices cannot be paired with {n_b}")
    on = ["i", "j"] + (["matrix_id"] if n_a == n_b and n_a > 1 else [])
    x, y = a.withColumnRenamed("v", "a"), b.withColumnRenamed("v", "b")
    if len(on) == 2:
        y, x = (y.drop("matrix_id"), x) if n_b == 1 else (y, x.drop("matrix_id"))
    return x.join(y, on, "inner").select("matrix_id", "i", "j", "a", "b")
