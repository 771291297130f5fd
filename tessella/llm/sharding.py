"""Sharding by minimax contiguous partition of atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import drop_table, gapless, materialise

#: Groups to a block that is read whole; bits of the key that divide the blocks of one level, at most.
BLOCK_GROUPS, LEVEL_BITS = 4096, 12


def level_bits(n_groups: int) -> list[int]:
    """Bits of the key by which each level divides the one above, until a block has about BLOCK_GROUPS groups."""
    left, out = max(0, int(np.ceil(np.log2(max(n_groups, 1) / BLOCK_GROUPS)))), []
    while left > 0:
        out.append(min(left, LEVEL_BITS))
        left -= out[-1]
    return out


class BlockedSizes:
    """Prefix sums of an ordered list of positive sizes that lie in a tree of blocks, of which only the parts asked for are read.

    fetch(depth, blocks) returns, per block of that depth (a number, the root being 0 at depth 0), the sizes of its parts
    in order: of its child blocks, or above depth `depth` of its groups, then with their keys. What was read is kept, so
    a search that goes over the same ground again and again reads each block once.
    """

    def __init__(self, bits: list[int], fetch):
        self.bits, self.fetch, self.seen = bits, fetch, {}
        self.total = 0
        self._read(0, {0: 0})
        self.total = int(self.seen[0, 0][0][-1])

    def _read(self, depth: int, blocks: dict[int, int]) -> None:
        """Read the given blocks of a depth, whose first prefix sums are known."""
        for b, (sizes, keys) in self.fetch(depth, sorted(blocks)).items():
            self.seen[depth, b] = (blocks[b] + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), keys)

    def _leaf(self, x: int) -> tuple[int, int] | tuple[int, int, int]:
        """The block of the last depth that x < total falls into, or the first one on the way that is not read, with its first prefix sum."""
        depth, b = 0, 0
        while depth < len(self.bits):
            sums = self.seen[depth, b][0]
            k = int(np.searchsorted(sums, x, side="right")) - 1
            depth, b = depth + 1, (b << self.bits[depth]) + k
            if (depth, b) not in self.seen:
                return depth, b, int(sums[k])
        return depth, b

    def prepare(self, xs) -> None:
        """Read all blocks that the positions fall into, one depth at a time."""
        xs = [x for x in xs if 0 <= x < self.total]
        while missing := {m[:2]: m[2] for m in map(self._leaf, xs) if len(m) == 3}:
            depth = min(d for d, _ in missing)
            self._read(depth, {b: at for (d, b), at in missing.items() if d == depth})

    def _sums(self, x: int, hints) -> np.ndarray:
        self.prepare([x, *hints] if len(self._leaf(x)) == 3 else [])
        return self.seen[self._leaf(x)][0]

    def floor(self, x: int, hints=()) -> int:
        """The largest prefix sum <= x."""
        if x >= self.total:
            return self.total
        sums = self._sums(x, hints)
        return int(sums[np.searchsorted(sums, x, side="right") - 1])

    def ceil(self, x: int, hints=()) -> int:
        """The smallest prefix sum >= x."""
        if x <= 0 or x >= self.total:
            return min(max(int(x), 0), self.total)
        sums = self._sums(x, hints)
        return int(sums[np.searchsorted(sums, x, side="left")])

    def key_at(self, x: int):
        """Key of the group that starts at prefix sum x < total."""
        sums = self._sums(x, ())
        return self.seen[self._leaf(x)][1][int(np.searchsorted(sums, x, side="left"))]


def minimax_cuts(sizes: BlockedSizes, n_shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and n_shards - 1 cut positions, as prefix sums.

    A capacity is feasible if the greedy walk, which fills each shard as far as it goes, ends within n_shards.
    Within that capacity each cut is put where it leaves the rest evenly spread, so shards are not just under
    the bound but near equal.
    """
    total = sizes.total
    even = -(-total // n_shards)

    def ahead(p: int, step: int) -> list[int]:
        return [p + step * k for k in range(1, n_shards + 1)]

    def feasible(cap: int) -> bool:
        p = 0
        for _ in range(n_shards):
            p = sizes.floor(p + cap, ahead(p, cap))
            if p >= total:
                return True
        return False

    low, high = max(even, largest), even + largest  # a shard closes only above high - largest >= even
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    cap, first = low, [total]
    for _ in range(n_shards):
        first.append(sizes.ceil(first[-1] - cap, ahead(first[-1], -cap)))
    cuts, p = [], 0
    for k in range(1, n_shards):
        target = p + -(-(total - p) // (n_shards - k + 1))
        below, above = sizes.floor(target), sizes.ceil(target)
        cut = below if target - below <= above - target else above
        p = max(p, first[n_shards - k], min(cut, sizes.floor(p + cap)))
        cuts.append(p)
    return cap, cuts


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Shard and slot of every row, with the largest shard as small as contiguous cuts allow.

    Rows with equal texts are one atomic group; null text counts as the empty text, of no bytes. Groups are ordered by the
    SHA-256 of their text. Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each
    shard, in the order of a hash of doc_id), grown_shard (null). Repeated rows get slots of their own; other
    columns are not read; an empty table gives an empty result; trailing shards are empty if there are fewer groups.

    The driver reads byte totals of at most 4,096 blocks at a time, level by level, for the few blocks that cuts fall into; a block
    of the last level has about 4,096 groups, however many there are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("gkey"),
    )
    keys = materialise(rows.withColumn("place", F.conv(F.hex(F.substring("gkey", 1, 7)), 16, 10).cast("long")), "shard-keys")
    n_rows = keys.count()
    bits = level_bits(n_rows)
    groups = materialise(keys.groupBy("gkey", "place").agg(F.sum("size").alias("bytes")), "shard-groups")

    def fetch(depth: int, blocks: list[int]) -> dict:
        above = sum(bits[:depth])
        mine = groups if not above else groups.withColumn("block", F.shiftright("place", 56 - above)).where(F.col("block").isin(blocks))
        mine = mine if above else mine.withColumn("block", F.lit(0).cast("long"))
        if depth == len(bits):
            found = mine.select("block", "gkey", "bytes").toPandas()
            found["gkey"] = found["gkey"].map(bytes)
            parts = dict(iter(found.sort_values(["block", "gkey"]).groupby("block")))
            return {b: (parts[b]["bytes"].to_numpy(dtype=np.int64), parts[b]["gkey"].tolist()) if b in parts else (np.zeros(0, dtype=np.int64), []) for b in blocks}
        child = F.shiftright("place", 56 - above - bits[depth]).bitwiseAND((1 << bits[depth]) - 1)
        found = mine.groupBy("block", child.alias("child")).agg(F.sum("bytes").alias("bytes")).toPandas()
        out = {b: np.zeros(1 << bits[depth], dtype=np.int64) for b in blocks}
        for b, part in found.groupby("block"):
            out[int(b)][part["child"].to_numpy(dtype=np.int64)] = part["bytes"].to_numpy(dtype=np.int64)
        return {b: (x, None) for b, x in out.items()}

    cut_keys = []
    if n_rows:
        sizes = BlockedSizes(bits, fetch)
        _, cuts = minimax_cuts(sizes, n_shards, groups.agg(F.max("bytes")).first()[0])
        cut_keys = [sizes.key_at(c) for c in cuts if c < sizes.total]
    drop_table(groups)
    shard = F.lit(0)
    for k in cut_keys:
        shard = shard + (F.col("gkey") >= F.lit(bytearray(k))).cast("int")
    placed = keys.withColumn("shard", shard)
    return gapless(placed, "shard", ["doc_id"], ["gkey"], n_rows, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
