"""Target-distribution importance resampling: two Arrow passes over the texts and a draw by noisy scores.

The first pass makes one vector of bucket counts per partition, which treeReduce() adds up; the second gathers the gains of a text's
features, which are broadcast (one number per bucket), and sums them by text. Scores are integers in a range that doesn't depend on the
data, so their histogram gives the cut and the ranks, and only drawn rows are shuffled.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import as_strings, materialise, split_words, text_slices

BUCKETS = 10_000
#: Levels of the tree that adds up the partitions' counts: of a million partitions, some hundred vectors come to the driver.
DEPTH = 3

#: Each byte of a text as it counts: A-Z in lower case, other ASCII characters than digits and letters as a space.
CHARACTERS = np.arange(256, dtype=np.uint8)
CHARACTERS[:0x80] = [ord(c.lower()) if (c := chr(b)).isalnum() else 0x20 for b in range(0x80)]


def features(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a large_string array without nulls: the text of each feature, its bucket, and the words of each text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(CHARACTERS[data]))
    ends, codes, table = split_words(plain, lower=False)
    n_words = np.diff(ends)
    owner = np.repeat(np.arange(len(texts)), n_words)
    words = [w.encode() for w in table.to_pylist()]
    sums = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    owners, found = [owner], [sums[codes] % buckets]
    for n in range(2, max_n + 1):
        whole = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
        runs = np.stack([codes[whole + k] for k in range(n)], axis=1) if len(whole) else np.zeros((0, n), dtype=np.int64)
        distinct, back = np.unique(runs, axis=0, return_inverse=True)
        hashed = np.array([zlib.crc32(b" ".join(words[c] for c in run)) for run in distinct.tolist()], dtype=np.int64)
        owners.append(owner[whole])
        found.append(hashed[back.ravel()] % buckets)
    return np.concatenate(owners), np.concatenate(found), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; null texts have none, an empty table gives zeros."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, some in text_slices(as_strings(batch.column(0))):
                total += np.bincount(features(some, max_n, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    partitions = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "counts binary").rdd
    if not partitions.getNumPartitions():
        return np.zeros(buckets, dtype=np.int64)
    return partitions.map(lambda row: np.frombuffer(row[0], dtype=np.int64)).treeReduce(np.add, depth=DEPTH)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the raw texts, in doubles."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1) -> DataFrame:
    """doc_id, n_features, n_words and weight, the floored mean of the gains of a text's features (none: 0), one row per input row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ("n_features", "n_words", "weight")

    def run(batches):
        gain = shared.value
        for batch in batches:
            for at, some in text_slices(as_strings(batch.column(1))):
                owner, bucket, n_words = features(some, max_n, len(gain))
                n = np.bincount(owner, minlength=len(some))
                total = np.bincount(owner, weights=gain[bucket], minlength=len(some)).astype(np.int64)
                columns = [pc.cast(pa.array(x), pa.int64()) for x in (n, n_words, total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *columns], names=["doc_id", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names)]))


def noise(seed: int, id_column):
    """A long per id: 1000 times standard Gumbel noise, floored, from the first 32 bits of sha256("<seed>:<id>")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = 10, min_words: int = 20, max_n: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Draw share percent of the documents with at least min_words words, rounded down, with odds that follow how much a text resembles target.

    Returns doc_id, n_features, weight, score (weight plus Gumbel noise that its id decides) and rank (1, 2, 3 ... in the order of
    score, greatest first, ties to the smaller doc_id; null where not drawn), all long but doc_id, one row per input row. Words are runs of
    digits, lower-cased ASCII letters and non-ASCII characters; features are runs of 1 to max_n words, repeats counted. Null texts are empty; texts
    without words weigh 0; a null id counts as the empty text in the noise and comes last among ties; rows that repeat an id share their noise and rank one
    after another; an empty target gives every bucket the same share; other columns are not read; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    scored = materialise(weigh(docs, gain, id_col, text_col, max_n).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "scores")
    # a gain lies within 1000 ln(2^126), the noise within 1000 ln(2^33): at most some 200,000 different scores, whatever the data
    per_score = sorted(scored.where(F.col("n_words") >= min_words).groupBy("score").count().collect(), reverse=True)
    left, firsts = sum(r[1] for r in per_score) * share // 100, []
    wanted = left
    for score, n in per_score:
        if left <= 0:
            break
        firsts.append((score, wanted - left))
        left -= n
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not firsts:
        return scored.select(*out, none)
    drawn = (F.col("n_words") >= min_words) & (F.col("score") >= firsts[-1][0])
    before = F.broadcast(docs.sparkSession.createDataFrame(firsts, "score long, __before long"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    top = scored.where(drawn).join(before, "score").withColumn("rank", place.cast("long"))
    return scored.where(~drawn).select(*out, none).unionByName(top.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")))
