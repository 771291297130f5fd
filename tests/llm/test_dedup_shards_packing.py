import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import _common, sharding
from tessella.llm import exact_dedup as ed
from tessella.llm.packing import bucket_bounds, pack
from tessella.llm.sharding import BlockedSizes, assign_shards, minimax_cuts

from .conftest import lower


def expected_dedup(corpus):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[lower(t)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_exact_dedup_matches_brute_force(frame, corpus, request):
    got = ed.exact_dedup(request.getfixturevalue(frame)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == expected_dedup(corpus)


def test_exact_dedup_empty_table(empty):
    assert ed.exact_dedup(empty).collect() == []


def test_exact_dedup_keeps_one_of_repeated_and_null_ids(spark):
    rows = [(1, "A"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [(False, 3, False), (False, 3, False), (False, 3, True), (True, 2, False), (True, 2, True)]


def test_exact_dedup_resolves_colliding_chunk_hashes(spark, monkeypatch):
    """With a hash of 1 bit nearly all chunks collide; digests still tell the texts apart."""
    import pyspark.sql.functions as F

    real = F.xxhash64
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(2)) if len(c) == 1 else real(*c))
    rows = [(i, t) for i, t in enumerate(["x", "y", "z", "X", "w" * 9000, "w" * 9000 + "v"])]
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {0: 3, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_keep_distinct_returns_the_columns_of_documents(docs, corpus):
    kept = ed.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in expected_dedup(corpus).items() if v[2])


def test_keep_distinct_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "B"), (3, "d"), (None, "e"), (4, "E"), (None, "f"), (None, "F"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as __row").repartition(3)
    got = ed.keep_distinct(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0), (r.text or "").lower()) for r in got.collect()) == [(0, "f"), (1, "a"), (2, "c"), (3, "b"), (3, "d"), (4, "e"), (5, "")]


def smallest_capacity(sizes, k):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                n, fill = n + 1, 0
            fill += s
        low, high = (low, mid) if n <= k else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(40))
def test_cuts_reach_the_smallest_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([16, 16, 40, rng.randint(16, 3000)]) for _ in range(rng.randint(1, 200))]
    k, bits = rng.randint(1, 40), [rng.randint(1, 3) for _ in range(rng.randint(0, 3))]
    places = sorted(rng.randrange(1 << sum(bits)) for _ in sizes)

    def fetch(depth, blocks):
        """The tree of blocks over places, of which each group has one."""
        above, out = sum(bits[:depth]), {}
        for b in blocks:
            own = [i for i, p in enumerate(places) if p >> (sum(bits) - above) == b]
            if depth == len(bits):
                out[b] = (np.array([sizes[i] for i in own], dtype=np.int64), own)
            else:
                out[b] = (np.zeros(1 << bits[depth], dtype=np.int64), None)
                for i in own:
                    out[b][0][(places[i] >> (sum(bits) - above - bits[depth])) & ((1 << bits[depth]) - 1)] += sizes[i]
        return out

    index = BlockedSizes(bits, fetch)
    capacity, cuts = minimax_cuts(index, k, max(sizes))
    sums = [0, *itertools.accumulate(sizes)]
    parts = [b - a for a, b in itertools.pairwise([0, *cuts, sums[-1]])]
    assert capacity == smallest_capacity(sizes, k)
    assert max(parts) <= capacity and min(parts) >= 0 and set(cuts) <= set(sums)
    assert all(index.key_at(c) == sums.index(c) for c in cuts if c < sums[-1])


@pytest.mark.parametrize(("frame", "groups", "bits"), [("docs", 4096, 12), ("docs", 2, 1), ("clashing", 1, 3)])
def test_shards(frame, groups, bits, corpus, request, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", groups)
    monkeypatch.setattr(sharding, "LEVEL_BITS", bits)
    monkeypatch.setattr(_common, "CELL_ROWS", 5)
    got = assign_shards(request.getfixturevalue(frame), 7).collect()
    text = {i: t or "" for i, t, *_ in corpus}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text.items()}
    assert len({(text[r.doc_id], r.shard) for r in got}) == len(set(text.values()))
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    groups = Counter()
    for r in got:
        groups[hashlib.sha256(text[r.doc_id].encode()).digest()] += r.size
    ordered = [groups[k] for k in sorted(groups)]
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) <= smallest_capacity(ordered, 7)


def test_shards_of_an_empty_table(empty):
    assert assign_shards(empty, 3).collect() == []


def best_padding(lengths, k):
    values = sorted(set(lengths))
    best = min(
        sum(min(b for b in (*c, values[-1]) if b >= n) - n for n in lengths)
        for r in range(min(k, len(values)))
        for c in itertools.combinations(values[:-1], r)
    )
    return best


@pytest.mark.parametrize("seed", range(20))
def test_bucket_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 30))]
    k = rng.randint(1, 4)
    bounds = bucket_bounds(np.bincount(lengths, minlength=13), k)
    assert len(bounds) <= k and bounds == sorted(set(bounds))
    assert sum(min(b for b in bounds if b >= n) - n for n in lengths) == best_padding(lengths, k)


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_pack_loses_nothing(frame, corpus, request):
    got = pack(request.getfixturevalue(frame), max_len=64, n_buckets=4, budget=256).collect()
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
        assert 0 <= r.length <= r.bucket_len <= 64 and r.padding == r.bucket_len - r.length and r.start == 64 * r.piece
    assert length == Counter({i: len((t or "").split()) for i, t, *_ in corpus})
    for b in {r.bucket_len for r in got}:
        per, own = max(1, 256 // max(b, 1)), [r for r in got if r.bucket_len == b]
        assert sorted(r.batch * per + r.slot for r in own) == list(range(len(own))) and all(r.slot < per for r in own)
    bounds = bucket_bounds(np.bincount([r.length for r in got], minlength=65), 4)
    assert {r.bucket_len for r in got} == set(bounds)


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, None), ("c", "z " * 100)], "doc_id string, text string")
    assert {r.doc_id: r.slot for r in assign_shards(df, 1).collect()}.keys() == {"a", "b", "c", None}
    assert {r.doc_id for r in pack(df, max_len=64).collect()} == {"a", "b", "c", None}
    assert {r.doc_id: r.keep_id for r in ed.exact_dedup(df).collect()} == {"a": "b", "b": "b", "c": "c", None: None}


def test_pack_of_an_empty_table(empty):
    assert pack(empty).collect() == []


def test_rows_are_told_apart_without_a_copy_of_their_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.llm._common import numbered

    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 6), (2, "", 7)] * 3, "doc_id long, text string, __row int").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows, row = numbered(docs)
    assert row == "__row_" and set(rows.inputFiles()) == set(docs.inputFiles())
    first, again = ({r[row] for r in df.collect()} for df in (rows, numbered(spark.read.parquet(path))[0].repartition(2)))
    assert len(first) == 12 and first == again
    twice, row = numbered(docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")))
    assert twice.select(row).distinct().count() == 24
