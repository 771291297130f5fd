"""Packing into optimal length buckets: boundaries by dynamic programming, batches by token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import WORD, gapless, materialise


def bucket_bounds(counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets length buckets that minimise total padding; counts[l] sequences have length l.

    best[k][j]: least padding of lengths up to j in k buckets, the last ending at j. The cost of a bucket (i, j] is
    j * number - sum of lengths in it, from prefix sums, so each of the n_buckets rounds is one vectorised pass
    over pairs of lengths. The last bound is the longest length there is.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(np.float64)
    m = len(lengths)
    best = np.concatenate([[0.0], lengths * n[1:] - s[1:]])
    back = np.zeros((n_buckets + 1, m + 1), dtype=np.int64)
    levels = [best]
    for k in range(2, n_buckets + 1):
        now = levels[-1].copy()
        back[k] = -1  # -1: no gain from one more bucket
        for j in range(k, m + 1):
            cost = levels[-1][1:j] + lengths[j - 1] * (n[j] - n[1:j]) - (s[j] - s[1:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], back[k][j] = cost[i], i + 1
        levels.append(now)
    bounds, j, k = [], m, len(levels)
    while j > 0:
        while k > 1 and back[k][j] == -1:
            k -= 1
        bounds.append(int(lengths[j - 1]))
        j, k = (int(back[k][j]), k - 1) if k > 1 else (0, 0)
    return bounds[::-1]


def pack(docs: DataFrame, max_len: int = 2048, n_buckets: int = 8, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batch and place of every sequence.

    A document's words are cut into sequences of at most max_len; a document without words (null or empty text
    too) is one sequence of length 0. Returns doc_id, piece, start (first word), length, bucket_len, batch (numbered
    in each bucket), slot (place in the batch, gapless), padding. A batch holds max(1, budget // bucket_len)
    sequences; only the last of a bucket may hold fewer. Repeated rows are sequences of their own; other columns are
    not read; an empty table gives an empty result. The histogram that the driver reads has max_len + 1 rows at most.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    pieces = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).select(
        "doc_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / max_len).cast("int") - 1, F.lit(0)))).alias("piece")
    )
    start = F.col("piece") * max_len
    table = materialise(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(max_len)).cast("int").alias("length")), "pieces")
    seen = table.groupBy("length").count().toPandas()
    counts = np.zeros(max_len + 1, dtype=np.int64)
    counts[seen["length"].to_numpy(dtype=np.int64)] = seen["count"].to_numpy(dtype=np.int64)
    bounds = bucket_bounds(counts, n_buckets)
    bucket = F.lit(max_len)
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, b).otherwise(bucket)
    ranked = gapless(table.withColumn("bucket_len", bucket), "bucket_len", ["doc_id", "piece"], ["length"], int(counts.sum()), 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return ranked.select(
        "doc_id", "piece", "start", "length", "bucket_len", F.floor(F.col("rank") / per).cast("long").alias("batch"), (F.col("rank") % per).cast("int").alias("slot"), (F.col("bucket_len") - F.col("length")).alias("padding")
    )
