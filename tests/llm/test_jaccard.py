import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import jaccard_join as jj

from .conftest import lower


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_components_match_brute_force(frame, corpus, request):
    got = jj.jaccard_classes(request.getfixturevalue(frame)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes([(i, t) for i, t, *_ in corpus])


def test_near_copies_chains_and_frequent_passages(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    chain = [word() for _ in range(120)]
    for i in range(12):
        rows.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    base = [word() for _ in range(150)]
    for _ in range(40):
        near = list(base)
        near[rng.randrange(150)] = word()
        rows.append(" ".join(near))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(10, 200))]) for _ in range(40)]
    rows += [" ".join(passage[:n]) for n in (20, 30, 38, 39, 40)]
    rows = list(enumerate(rows))
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)


@pytest.mark.parametrize(("share", "hot", "part"), [(300, 50_000, 20_000), (2000, 5, 20_000), (10**6, 3, 40), (400, 50_000, 7)])
def test_worlds_shingles_and_partitions_of_any_size(spark, monkeypatch, share, hot, part):
    """Worlds beyond a task's share, hot shingles, many partitions: a mass of near copies, a chain whose ends share nothing, hubs."""
    monkeypatch.setattr(jj, "TASK_SHINGLES", share)
    monkeypatch.setattr(jj, "LEAST_TASK_SHINGLES", share)
    monkeypatch.setattr(jj, "HOT_ENTRIES", hot)
    monkeypatch.setattr(jj, "PART_ENTRIES", part)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    base, chain, rows = [word() for _ in range(120)], [word() for _ in range(100)], []
    for _ in range(30):
        near = list(base)
        near[rng.randrange(120)] = word()
        rows.append(" ".join(near))
        rows.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    rows += [" ".join(base[:n] + [word() for _ in range(30)]) for n in range(20, 120, 5)]
    rows = list(enumerate(rows))
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)


def test_salted_entries_still_meet():
    rng = np.random.default_rng(0)
    tokens, ids = rng.integers(1, 9, 4000).astype(np.uint64), rng.integers(1, 2**62, 4000).astype(np.uint64)
    salts = np.where(tokens < 4, 5, 1)
    t, d, s = jj.salted(tokens, ids, np.full(4000, 7, dtype=np.uint8), salts)
    assert len(t) == len(d) == len(s) == (salts**2 * (salts > 1) // 5 + (salts == 1)).sum()
    keys = {}
    for key, own in zip(t.tolist(), d.tolist(), strict=True):
        keys.setdefault(own, set()).add(key)
    for token in (2, 7):
        same = [keys[x] for x in d[np.isin(d, ids[tokens == token])][:60].tolist()]
        assert all(a & b for a in same for b in same)
    hot = [key for key, n in zip(*np.unique(t, return_counts=True), strict=True) if n > 300]
    assert all(k in (4, 5, 6, 7, 8) for k in hot)  # no key of a salted shingle has more than two fifths of its entries


def test_trees_prune_and_near_copies_cost_their_length(spark):
    """Node pairs are pruned on unrelated documents; a mass of near copies is joined without looking at all its leaf pairs."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [" ".join(word() for _ in range(rng.randrange(8, 90))) for _ in range(600)]
    rows = [(k, t) for k, text in enumerate(rows) for t in (text, text + " end")]
    sets, counts = jj.representatives(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    seen, pruned = jj.signature_links(sets, counts).selectExpr("sum(seen)", "sum(pruned)").first()
    assert pruned > seen / 4 > 0
    n = 2000
    base = np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)
    maps = []
    for _ in range(n):
        own = base.copy()
        own[rng.randrange(100)] = rng.randrange(2**63)
        maps.append(jj.bitmap(own, int(jj.bitmap_class(np.array([100]))[0])))
    found = jj.candidate_links(np.full(n, 100), maps, np.arange(n), np.zeros(n, dtype=np.int64))
    assert len(set(found.labels().tolist())) == 1 and found.seen < 20 * n / jj.LEAF


def test_text_ids(spark):
    text = "one two three four five six seven"
    got = jj.jaccard_classes(spark.createDataFrame([("b", text), ("a", text), (None, ""), ("c", None)], "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("None", 0, "None"), ("a", 3, "a"), ("b", 3, "a"), ("c", 0, "c")]


def test_empty_table_null_and_repeated_ids(spark, empty):
    assert jj.jaccard_classes(empty).collect() == []
    rows = [(None, "a b c d e f"), (7, "A b c d e f"), (7, "a b c d e f"), (None, None), (3, "")]
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 0, "3"), ("7", 2, "7"), ("7", 2, "7"), ("None", 0, "None"), ("None", 2, "7")]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tree_join_loses_no_linking_pair(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10_000)))
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(data.draw(st.integers(2, 60))):
        own = base[: rng.integers(20, 60)].copy()
        change = rng.random(len(own)) < rng.choice([0.0, 0.05, 0.3, 1.0])
        own[change] = rng.integers(0, 2**63, change.sum()).astype(np.uint64)
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets])
    shingle = data.draw(st.integers(1, 8))
    entries = [(k, int(x)) for k, s in enumerate(sets) for x in np.unique(s % np.uint64(shingle))]
    member, dealt = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
    label = jj.exact_classes(sets)
    found = jj.candidate_links(sizes, [jj.bitmap(s, int(w)) for s, w in zip(sets, jj.bitmap_class(sizes), strict=True)], member, dealt)
    joined = jj.Classes(len(sets))
    joined.add(np.array([a for a, _ in found.links], dtype=int), np.array([b for _, b in found.links], dtype=int))
    for a in range(len(sets)):
        assert joined.find(a) == joined.find(int(label[a])) == found.find(a)


def test_sizes_that_may_link_are_never_parted():
    sizes = np.unique(np.concatenate([np.arange(1, 5000), 2 ** np.arange(1, 31), 3 * 2 ** np.arange(1, 29)]))
    classes = jj.size_class(sizes).astype(int)
    assert (np.diff(classes) >= 0).all()
    for n, c in zip(sizes.tolist(), classes.tolist(), strict=True):
        near = classes[(sizes >= n) & (3 * sizes <= 4 * n)]
        assert near.max() - c <= jj.STEPS + 1


def test_sets_with_one_short_id_are_told_apart(spark, monkeypatch):
    """With ids of few bits, unrelated sets share them; every link is still found, since each set of an id gets the groups of all of them."""
    plain = jj.set_digests

    def short(offsets, hashes):
        out = plain(offsets, hashes)
        out[:, 0] &= np.uint64(1023)
        return out

    monkeypatch.setattr(jj, "set_digests", short)
    rng = random.Random(9)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(40)]
        rows += [" ".join(words), " ".join([*words[:-1], "other"])]
    rows = list(enumerate(rows))
    got = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(rows)
