"""Wide abundance matrices to long rows and back, reference intensities, missingness patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_nan(c: Column) -> Column:
    """NaN means missing in the data model; Spark keeps the two apart."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def unpivot_samples(wide: DataFrame, ids: list[str], name: str = "sample", value: str = "value", samples: list[str] | None = None) -> DataFrame:
    """One row per sample column, nulls kept."""
    columns = samples if samples is not None else [c for c in wide.columns if c not in ids]
    return wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`").cast("double").alias(c) for c in columns], name, value)


def subtract_reference(wide: DataFrame, samples: list[str], reference: str = "ReferenceIntensity", keep: bool = True) -> DataFrame:
    """Each sample column less the reference column, which stays or goes."""
    return wide.select(*[(F.col(f"`{c}`") - F.col(f"`{reference}`")).alias(c) if c in samples else F.col(f"`{c}`") for c in wide.columns if keep or c != reference])


def gene_means(peptides: DataFrame, gene: str, samples: list[str]) -> DataFrame:
    """Mean of each sample over the peptides of a gene; missing values and null genes are left out."""
    return peptides.where(F.col(f"`{gene}`").isNotNull()).groupBy(gene).agg(*[F.avg(null_nan(F.col(f"`{c}`"))).alias(c) for c in samples])


def samples_by_genes(long: DataFrame, gene: str, genes: list[str], sample: str = "sample", value: str = "value") -> DataFrame:
    """One row per sample and one column per gene of a stated list, so the plan needs no pass to find them."""
    return long.groupBy(sample).pivot(gene, genes).agg(F.first(value, ignorenulls=True))


def has_prefix(df: DataFrame, expected: list[str]) -> bool:
    """Whether the columns that both have agree in place; a table with fewer columns passes."""
    return all(a == b for a, b in zip(df.columns, expected, strict=False))


def missing_patterns(wide: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Rows grouped by which of the columns are missing: pattern (list of booleans), n_rows, first_row."""
    pattern = F.array(*[F.coalesce(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), F.lit(True)) for c in columns])
    return wide.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n_rows"), F.min(row_id).alias("first_row"))


def column_difference(df: DataFrame, known: list[str]) -> list[str]:
    return sorted(set(df.columns) - set(known))


def upper_products(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Upper triangle of each row's outer product: row_id, i, j (i <= j), v."""
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"`{a}`") * F.col(f"`{columns[j]}`")).alias("v")) for i, a in enumerate(columns) for j in range(i, len(columns))]
    return df.select(row_id, F.inline(F.array(*pairs)))


def submatrix(long: DataFrame, mask: list[int]) -> DataFrame:
    """Entries (i, j, v) of a square matrix whose indices are both selected by a 0/1 mask, renumbered from 0."""
    kept = [k for k, m in enumerate(mask) if m]
    if not kept:
        return long.where("false")
    place = F.create_map(*[F.lit(x) for k, old in enumerate(kept) for x in (old, k)])
    return long.where(F.col("i").isin(kept) & F.col("j").isin(kept)).select(F.element_at(place, F.col("i")).alias("i"), F.element_at(place, F.col("j")).alias("j"), "v")


def group_statistics(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """group, n, median, quantile (interpolated), var_pop, var_samp of a column per group. Exact quantiles count a group's distinct values in one task."""
    v = F.col(f"`{value}`")
    return df.groupBy(group).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, q).alias("quantile"), F.var_pop(v).alias("var_pop"), F.var_samp(v).alias("var_samp"))


def moving_statistics(df: DataFrame, group: str, order: str, value: str, width: int) -> DataFrame:
    """df with growing_std (of all rows of the group up to each) and rolling_mean (of the last width rows)."""
    w, v = Window.partitionBy(group).orderBy(order), F.col(f"`{value}`")
    return df.select("*", F.sqrt(F.var_pop(v).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("growing_std"), F.avg(v).over(w.rowsBetween(1 - width, 0)).alias("rolling_mean"))
