"""What the operators of this subpackage share: written intermediate tables, token codes, hot-key joins."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group is hot above this share of all rows, so there are at most 1,000 hot groups.
HOT_SHARE, SALTS = 1000, 64


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../tessella-checkpoints"


def materialise(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage and survives lost executors. Small row groups bound
    what a writing task buffers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": str(16 << 20)} | (options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete tables written by materialise() once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame, *tags: str) -> None:
    """Delete the tables in the shared folder that df reads, once df will not be read again; with tags, only tables written under those. Lazy
    results of operators read such tables, which stay until then."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    shared = path(shared_dir(spark)).toUri().getPath()
    for folder in {path(f).getParent().toString() for f in df.inputFiles()}:
        at = path(folder)
        if at.getParent().toUri().getPath() == shared and (not tags or at.getName().rpartition("-")[0] in tags):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Left join of rows to one row per key, with hot keys split over SALTS partitions.

    Keys that hold more than 1/HOT_SHARE of all rows are fewer than HOT_SHARE, whatever the data, so they
    are broadcast; their group row is repeated for each salt.
    """
    hot = groups.where(F.col(size) > F.lit(max(n_rows // HOT_SHARE, 1000))).select(F.col(key).alias("__hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SALTS)).cast("int"))).drop("__hot")
    many = groups.withColumn("__n", F.when(F.col(size) > F.lit(max(n_rows // HOT_SHARE, 1000)), SALTS).otherwise(1))
    many = many.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return marked.join(many, [key, "__salt"], "left").drop("__salt")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further column that tells rows apart, also ones that repeat or share an id, and that column's name.

    Rows of a Parquet table are named by file and place in the file, which every reading finds again. Anything else is written once, with numbers.
    """
    name = "__row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    # a bare table only: above a join or an explode, one place of a file may stand for several rows
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            return docs.select("*", F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.hex("_metadata.row_index")).alias(name)), name
        except AnalysisException:  # a format without places
            pass
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _bitmap_marks(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with a column hit, false where key is surely not in the one column of ids.

    A bitmap of hashed ids, 32 MB at most whatever the data, is broadcast, so rows are not shuffled. ids is read twice and should be
    a written table.
    """
    n, (id_col,) = ids.count(), ids.columns
    bits = min(28, max(15, (max(n, 1) * 16 - 1).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`")), F.lit(1 << bits)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(spot(id_col)).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot(id_col))).alias("__bits"))
    place = F.bitmap_bit_position("__spot")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    spotted = rows.withColumn("__spot", spot(key)).withColumn("__bucket", F.bitmap_bucket_number("__spot"))
    return spotted.join(F.broadcast(maps), "__bucket", "left").withColumn("hit", hit).drop("__bucket", "__spot", "__bits")


def in_bitmap(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ids, of the same type, and a few more: a filter before a join."""
    return _bitmap_marks(rows, key, ids).where("hit").drop("hit")


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the one column of ids; rows with a null id stay.

    Rows that a bitmap of the ids rules out pass by without a shuffle, and only the rest, the rows to drop and a few more, are joined.
    """
    drop = materialise(ids.select(F.col(ids.columns[0]).cast("string").alias("__drop")).where("__drop is not null").distinct(), "drop")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("key"))
    marked = _bitmap_marks(rows, "key", drop)
    rest = marked.where("hit").join(drop, F.col("key") == F.col("__drop"), "left_anti")
    return marked.where("not hit").select("row.*").unionByName(rest.select("row.*"))


#: Rows that one task numbers in gapless().
CELL_ROWS = 50_000


def gapless(rows: DataFrame, group: str, ids: list[str], rest: list[str], n_rows: int, n_groups: int) -> DataFrame:
    """rows with a column rank, gapless from 0 in each group, in the order of a hash of ids.

    A group is split into cells of about CELL_ROWS rows by that hash, so a large group is numbered by many tasks. What the cells before one hold is
    summed from one count per cell; nothing comes to the driver and nothing is broadcast by force: rows lie by
    (group, cell) already when the sums are joined. rest breaks ties between rows with equal ids.
    """
    cells = max(1, -(-n_rows // (n_groups * CELL_ROWS)))
    dealt = rows.withColumn("__hash", F.xxhash64(*ids)).withColumn("__cell", F.pmod("__hash", F.lit(cells)).cast("int"))
    counts = dealt.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    first = F.sum("__n").over(Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    at = F.row_number().over(Window.partitionBy(group, "__cell").orderBy("__hash", *ids, *rest))
    placed = dealt.withColumn("__at", at).join(counts.select(group, "__cell", first.alias("__first")), [group, "__cell"])
    return placed.withColumn("rank", F.col("__first") + F.col("__at") - 1).drop("__hash", "__cell", "__at", "__first")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows and 8 MB at most, for texts; called by the queries and the pipeline before they read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_slices(texts: pa.Array, max_bytes: int = 3 << 20):
    """(first row, slice) pairs of an Arrow string array, each of about max_bytes or one row, to bound memory; what Arrow's pool
    holds unused goes back to the system in the end."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 20_000]), max_bytes)))
        yield at, texts.slice(at, n)
        at += n
    pa.default_memory_pool().release_unused()


def as_strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of whole texts: offsets per text, a code per word, and the distinct words that the codes index."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = pc.ascii_split_whitespace(trimmed)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    encoded = pc.dictionary_encode(words)
    codes, table = np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary
    empty = pc.index(table, pa.scalar("", table.type)).as_py() if len(table) else -1
    if empty >= 0:  # a text without words splits into one empty string
        keep = codes != empty
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], kept[offsets]
    return offsets, codes, table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hashes built by adding can be used bit by bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(table: pa.Array) -> np.ndarray:
    """A 64-bit hash of every distinct word (SipHash with a fixed key, in C)."""
    if not len(table):
        return np.zeros(0, dtype=np.uint64)
    return hash_array(table.to_numpy(zero_copy_only=False), categorize=False)


#: At most so many labelled rows are used to fit a classifier, those with the smallest hash of their id.
FIT_ROWS = 20_000


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, held_out: tuple[int, int], fit_rows: int, unlabelled_rows: int = 0) -> DataFrame:
    """doc_id, label and text of the labelled rows to fit on, fit_rows at most, so their ids may be broadcast; and of unlabelled_rows rows
    without a label (label: -1), with the smallest hashes of their ids too. Ids of docs and labels are compared as text."""
    taught = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(held_out[0])) != held_out[1]
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(taught("doc_id")).where("label is not null").groupBy(F.col("doc_id").cast("string").alias("__id")).agg(F.max("label").cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    if unlabelled_rows:
        other = docs.where(taught(id_col)).select(F.col(id_col).cast("string").alias("__id")).join(labels.select(F.col("doc_id").cast("string").alias("__id")), "__id", "left_anti").distinct()
        ids = ids.unionByName(other.orderBy(F.xxhash64("__id"), "__id").limit(unlabelled_rows).withColumn("label", F.lit(-1)))
    return text.join(F.broadcast(ids), F.col("doc_id").cast("string") == F.col("__id")).select("doc_id", "label", "text")
