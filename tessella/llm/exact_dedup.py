"""Exact deduplication by content-defined chunk recipes, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import ascii_lower, join_groups, materialise, numbered, release, without_ids

#: A chunk ends after a line break or a comma or full stop with a space, 512 characters on at the earliest, or at 4,096.
CHUNK = r"(?s).{512,4096}?(?:\n|[.,] )|.{1,4096}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """One row per document: uid, doc_id, the digest of its normalised text and its ordered chunk identifiers.

    Chunks are cut where their own content says so, hashed, and the chunk hashes verified against a SHA-256
    digest of the chunk over the whole corpus. A hash that stands for two different chunks is replaced by the
    digest in every document that has it, so equal lists mean equal texts.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select((F.col(uid_col) if uid_col else F.monotonically_increasing_id()).alias("uid"), F.col(id_col).alias("doc_id"), norm.alias("norm"))
    chunk = lambda c: F.struct(F.xxhash64(c).alias("h"), F.substring(F.unhex(F.sha2(c.cast("binary"), 256)), 1, 16).alias("d"))
    table = materialise(
        base.select("uid", "doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)), chunk).alias("recipe")),
        "recipes",
    )
    chunks = table.select(F.explode("recipe").alias("c")).select("c.h", "c.d").groupBy("h").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    clashes = chunks.where("d0 <> d1").select("h")
    verified = F.transform("recipe", lambda x: F.unhex(F.hex(x["h"])))
    if clashes.isEmpty():
        return table.select("uid", "doc_id", "text_sha256", verified.alias("ids"))
    bad = table.select("uid", F.explode("recipe.h").alias("h")).join(clashes, "h", "left_semi").select("uid").distinct().withColumn("bad", F.lit(True))
    ids = F.when(F.col("bad"), F.transform("recipe", lambda x: x["d"])).otherwise(verified)
    return table.join(bad, "uid", "left").select("uid", "doc_id", "text_sha256", ids.alias("ids"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """Which row of each group of equal texts stays.

    Returns uid, doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Texts are equal when
    identical after lower-casing A-Z; null is the empty text, and empty texts are one group. The row with the
    largest doc_id stays; null ids sort below all others. If one doc_id repeats with the same text, exactly one of
    those rows has kept = true. Columns of the input other than those named are not read and can't clash.
    uid is the column uid_col, one value per row, or made here. An empty table gives an empty result.
    """
    rows = recipes(docs, id_col, text_col, uid_col)
    n_rows = rows.count()
    groups = rows.groupBy("ids").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1")
    joined = join_groups(rows, groups, "ids", "group_size", n_rows)
    return joined.select(
        "uid",
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("top").isNull() | (F.col("top.uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops: of each text one row stays, whether ids repeat or are null."""
    rows, row = numbered(docs)
    decided = exact_dedup(rows, id_col, text_col, row)
    out = without_ids(rows, row, decided.where("not kept").select("uid")).drop(row)
    release(decided, "recipes")
    return out
