"""A corpus pipeline: toxic documents go, then exact and near copies, then leaks of the benchmark; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm._common import bounded_batches, materialise, numbered, release, without_ids
from tessella.llm.decontaminate import find_leaks
from tessella.llm.exact_dedup import keep_distinct
from tessella.llm.jaccard_join import jaccard_classes
from tessella.llm.packing import pack


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on these documents and the labels, does not predict toxic."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; rows are told apart even where doc_ids repeat or are null."""
    return keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, one row with the smallest doc_id (null only if all are); decided by row, as in drop_copies()."""
    bounded_batches(spark)
    rows, row = numbered(docs)
    classes = jaccard_classes(rows, row)
    others = materialise(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("uid"), "component_id"), "near-copies")
    release(classes)
    members = others.union(others.select("component_id", "component_id").distinct())
    ids = rows.select(F.col(row).alias("uid"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("rank"))
    kept = members.join(ids, "uid").groupBy("component_id").agg(F.min("rank").getField(row).alias("uid"))
    return without_ids(rows, row, members.join(kept, "uid", "left_anti").select("uid")).drop(row)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, decided by row, as in drop_copies()."""
    bounded_batches(spark)
    rows, row = numbered(docs)
    return without_ids(rows, row, find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select("doc_id")).drop(row)


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("decontaminate", drop_leaks), ("packing", pack_rest)]

#: No SQL: label models, edit-distance search and optimal buckets are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each stage's result written to the shared folder and read again. What a stage has
    read and written besides is deleted then; the last stage's tables stay for the result, until release()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(kept, name)
            release(kept)
    return kept
