import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import decontaminate as dc
from tessella.llm._common import without_ids

from .conftest import SCHEMA, prose


def distance(item, text):
    """Fewest word edits between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(50))
def test_best_match_is_the_edit_distance(seed):
    rng = random.Random(seed)
    item, text = [rng.randrange(4) for _ in range(rng.randint(1, 70))], [rng.randrange(4) for _ in range(rng.randint(0, 90))]
    assert dc.best_match(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64))[0] == distance(item, text)


def normal(text):
    return [w for w in (x.lower().strip(dc.TRIM) for x in (text or "").split()) if w]


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, prose(rng, rng.randrange(15, 50), words)) for i in range(20)] + [(20, None), (21, "..."), (22, "w1 w2 w3")]
    docs = []
    for i in range(120):
        text = prose(rng, rng.randrange(0, 120), words).split()
        if i % 3 == 0:
            own = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(0, int(0.3 * len(own)))):
                kind, at = rng.randrange(3), rng.randrange(len(own))
                own[at : at + (kind > 0)] = [] if kind == 2 else ["EDIT!"]
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = [w.upper() + "***" if i % 2 else w for w in own]
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (202, items[3][1]), (202, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as edits").repartition(3)
    got = dc.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, t in docs:
        for i, x in items:
            item = normal(x)
            if item and (e := distance(item, normal(t))) <= int(0.2 * len(item) + 1e-9):
                want[d, i] = e
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(want) and len(found) >= 0.99 * len(want)
    assert all(found[k] == want[k] for k in found)
    assert sum(r.doc_id == 202 and r.item_id == 3 for r in got) == 2


def test_long_items_beyond_the_keys_are_searched_exactly():
    rng = np.random.default_rng(8)
    items = [rng.integers(1, 2**62, 700).astype(np.uint64) for _ in range(5)]
    index = dc.build_index(list("abcde"), items, 0.2, 0.99)
    assert index.exact and index.recall < 0.99
    for k in range(5):
        own = dc.edited(items[k], int(index.limits[k]), rng)
        text = np.concatenate([rng.integers(1, 2**62, 50).astype(np.uint64), own, rng.integers(1, 2**62, 50).astype(np.uint64)])
        assert [i for _, i, *_ in dc.search(np.array([0, len(text)]), text, index)] == [k]


def test_embedding_matches_a_walk_step_by_step():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 50, 300).astype(np.uint64)
    starts = rng.integers(0, 250, 20)
    ends = starts + rng.integers(0, 50, 20)
    places = rng.integers(0, 90, (20, 7))
    for walk in (0, 3):
        got = dc.embed(words, starts, ends, places, walk)
        for r in range(20):
            at, seen = int(starts[r]), []
            for j in range(90):
                now = words[at] if at < ends[r] else np.uint64(0)
                seen.append(int(now))
                step = (int(dc.mix64(np.array([now + np.uint64(0x9E3779B97F4A7C15 * (walk * 4096 + j + 1) % 2**64)]))[0]) >> 40) & 1
                at += step if at < ends[r] else 0
            assert got[r].tolist() == [seen[p] for p in places[r]]


def test_benchmarks_in_blocks_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 3)
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    bench = spark.createDataFrame([(f"i{k}", words(k)) for k in range(8)] + [(None, words(9)), ("none", None)], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{k}", "before " + words(k) + " after") for k in range(10)] + [("e", ""), (None, words(2)), ("n", None)], "doc_id string, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.edits) for r in dc.find_leaks(docs, bench).collect())
    assert got == sorted([(f"d{k}", f"i{k}", 0) for k in range(8)] + [("d9", "None", 0), ("None", "i2", 0)])


def test_recall_at_the_edit_limit():
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 2**60, n).astype(np.uint64) for n in rng.integers(15, 60, 40)]
    index = dc.build_index(np.arange(40), items, 0.2, 0.99)
    assert index.recall >= 0.99
    hits = 0
    for k in range(200):
        own = dc.edited(items[k % 40], int(index.limits[k % 40]), rng)
        text = np.concatenate([rng.integers(1, 2**60, 30).astype(np.uint64), own, rng.integers(1, 2**60, 30).astype(np.uint64)])
        hits += any(i == k % 40 for _, i, *_ in dc.search(np.array([0, len(text)]), text, index))
    assert hits >= 198


def test_large_benchmarks_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 3)
    rng = random.Random(1)
    items = [(i, prose(rng, 20, [f"x{k}" for k in range(500)])) for i in range(10)]
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in items] + [(99, "nothing here")], "doc_id long, text string")
    got = dc.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(i, i, 0) for i in range(10)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(docs, none).collect() == [] and dc.find_leaks(docs.where("false"), none).collect() == []


def test_words_of_arrow_slices():
    texts = pa.array(["A, b!", None, "", "c"])
    assert [(at, n, offsets.tolist()) for at, n, offsets, _ in dc.normal_words(texts)] == [(0, 4, [0, 2, 2, 2, 3])]


def test_without_ids(spark):
    df = spark.createDataFrame([(i, "x") for i in range(1000)] + [(None, "y")], "doc_id long, text string").selectExpr("*", "1 as __bits")
    drop = spark.createDataFrame([(i,) for i in range(0, 1000, 7)] + [(None,), (5000,)], "k long")
    got = without_ids(df, "doc_id", drop)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [i for i in range(1000) if i % 7] and got.where("doc_id is null").count() == 1
    assert without_ids(df, "doc_id", drop.where("false")).count() == 1001


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"p{i}" for i in range(800)]
    items = [(i, prose(rng, 30, words)) for i in range(5)]
    docs, toxic = [], set()
    for i in range(400):
        text = prose(rng, rng.randrange(30, 120), words).split()
        if i % 10 == 0:
            text[3], text[9], toxic = "idiot", "worthless", toxic | {i}
        if i % 17 == 5:
            text[5:5] = items[i % 5][1].split()
        docs.append([i, " ".join(text)])
    for i in range(400, 440):
        docs.append([i, docs[i - 400 + 1][1].upper() if i % 2 else docs[i - 400 + 1][1] + " extra"])
    docs += [[500, None], [501, ""]]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, items, toxic


def test_pipeline_stages_against_brute_force(spark, folder):
    from .test_dedup_shards_packing import expected_dedup
    from .test_jaccard import classes

    d, rows, items, toxic = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        before = [(r.doc_id, r.text) for r in docs.collect()]
        now = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            assert now == {i for i, t in before if "idiot" not in (t or "").lower().split()}
        elif name == "exact_dedup":
            assert now == {i for i, v in expected_dedup(before).items() if v[2]}
        elif name == "jaccard_join":
            assert now == {i for i, (_, c) in classes(before).items() if c == i}
        else:
            assert now == {i for i, t in before if all(distance(normal(x), normal(t)) > 6 for _, x in items)}
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        kept.append(now)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == kept[-1]
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len((t or "").split()) for i, t in rows if i in kept[-1]}


def test_pipeline_decides_by_row(spark, tmp_path):
    """Repeated rows and doc_ids: one copy of each text stays, and a row doesn't go for what another row with its id holds."""
    rng = random.Random(3)
    base, near, item, *own = (prose(rng, 40, [f"{k}w{i}" for i in range(500)]) for k in range(7))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def run(stage, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns
        return sorted((r.doc_id or 0, r.text) for r in got.collect())

    assert run(corpus_pipeline.drop_copies, [(1, base), (1, base), (2, base.upper()), (2, own[0]), (1, own[1])]) == sorted([(2, base.upper()), (2, own[0]), (1, own[1])])
    assert run(corpus_pipeline.drop_copies, [(1, base), (1, base)]) == [(1, base)]
    assert run(corpus_pipeline.drop_near_copies, [(3, near), (5, near + " x"), (5, near + " x"), (5, own[0]), (3, own[1])]) == sorted([(3, near), (5, own[0]), (3, own[1])])
    assert [i for i, _ in run(corpus_pipeline.drop_near_copies, [(3, near + " x"), (3, near)])] == [3]
    assert run(corpus_pipeline.drop_leaks, [(1, "a " + item), (1, own[0]), (2, own[1])]) == sorted([(1, own[0]), (2, own[1])])


def test_null_ids_are_searched_and_dropped(spark, tmp_path):
    rng = random.Random(6)
    base, near, item, nameless, own = (prose(rng, 40, [f"{k}w{i}" for i in range(500)]) for k in range(5))
    benchmark = spark.createDataFrame([(1, item), (None, nameless)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(None, base), (None, base), (None, near), (2, near + " x"), (None, "a " + item), (3, nameless), (None, own)], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.item_id, r.edits)) for r in dc.find_leaks(df, benchmark).collect()) == ["(3, None, 0)", "(None, 1, 0)"]
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_leaks):
        df = stage(spark, df, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in df.collect()) == sorted([(0, base), (2, near + " x"), (0, own)])
