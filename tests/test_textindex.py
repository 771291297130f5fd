import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import textindex as ti


def plain_frequency(words, phrase, slop):
    """Windows of a phrase by looking back from every place at the latest place of each word."""
    places = sorted((p - j, j) for j, w in enumerate(phrase) for p, x in enumerate(words) if x == w)
    total = 0.0
    for k, (q, _) in enumerate(places):
        last = {j: x for x, j in places[: k + 1]}
        if len(last) == len(phrase) and len({x + j for j, x in last.items()}) == len(phrase) and q - min(last.values()) <= slop:
            total += 1 / (1 + q - min(last.values()))
    return total


def test_frequency_of_phrases(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(150)] + [(900, None), (901, "A, b! c?")]
    df = spark.createDataFrame(rows, "i int, text string")
    for phrase, slop in (("a b", 0), ("a b", 2), ("b a c", 3), ("a a", 1), ("d", 0), ("a b a", 5)):
        own = phrase.split()
        words = ti.words_of(F.col("text"))
        of = lambda x: F.filter(F.transform(words, lambda w, k: F.when(w == x, k)), lambda p: p.isNotNull())
        at = [of(x) for x in own]
        got = {r[0]: r[1] for r in df.select("i", ti.phrase_frequency(at, slop)).collect()}
        for i, text in rows:
            assert got[i] == pytest.approx(plain_frequency(re.findall(r"\w+", (text or "").lower()), own, slop)), (text, phrase, slop)
        assert {r[0] for r in df.where(ti.has_phrase(F.col("text"), phrase, slop)).collect()} == {i for i, n in got.items() if n > 0}


def test_a_phrase_may_be_out_of_order_within_slop(spark):
    df = spark.createDataFrame([(1, "red big house"), (2, "big red house"), (3, "red old and big house"), (4, "house of red brick and big"), (5, None)], "i int, text string")
    found = lambda slop: {r[0] for r in ti.search_slop(df, '"big red"', ["text"], slop).collect()}
    assert found(0) == {2} and found(2) == {1, 2} and found(3) == {1, 2} and found(4) == {1, 2, 3, 4}
    assert [r[0] for r in ti.search_slop(df, '-"big red" i:<9', ["text"], 0).orderBy("i").collect()] == [1, 3, 4, 5]


DOCS = [(1, "Alpha beta gamma", "beta", "x", 3), (2, "beta beta beta delta", None, "y", 5), (3, "gamma alpha", "alpha alpha beta", "x", 7), (4, "", "Übung_1 beta", "z", 1), (5, None, None, "x", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string, kind string, n int")


def plain_score(doc, phrase, field, slop=5):
    text = lambda d: re.findall(r"\w+", (d[1 if field == "title" else 2] or "").lower())
    f = plain_frequency(text(doc), phrase, slop) if len(phrase) > 1 else text(doc).count(phrase[0])
    if not f:
        return None
    mean = sum(len(text(d)) for d in DOCS) / len(DOCS)
    idf = sum(math.log(1 + (len(DOCS) - n + 0.5) / (n + 0.5)) for n in (sum(w in text(d) for d in DOCS) for w in phrase))
    return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(text(doc)) / mean))


def plain_best(doc, phrase, fields=("title", "body")):
    own = [s for s in (plain_score(doc, phrase, f) for f in fields) if s is not None]
    return max(own) + 0.3 * (sum(own) - max(own)) if own else None


@pytest.mark.parametrize("written", [False, True])
def test_relevance_and_filters(spark, docs, tmp_path, written):
    index = ti.build_index(docs, "id", ["title", "body"])
    if written:
        ti.write_index(index, str(tmp_path / "index"))
        index = ti.read_index(spark, str(tmp_path / "index"))
    plain = docs.select("id", "kind", "n")
    ranked = lambda q: {r.id: r.score for r in ti.rank(plain, index, q, "id").collect()}
    by = {d[0]: d for d in DOCS}
    assert ranked("beta") == pytest.approx({i: s for i, d in by.items() if (s := plain_best(d, ["beta"])) is not None})
    assert ranked('"gamma alpha"') == pytest.approx({i: s for i, d in by.items() if (s := plain_best(d, ["gamma", "alpha"])) is not None})
    assert ranked("title:beta n:>3") == pytest.approx({2: plain_best(by[2], ["beta"], ["title"])})
    assert ranked("beta -alpha") == pytest.approx({i: plain_best(by[i], ["beta"]) for i in (2, 4)})
    assert ranked("alpha || kind:y") == pytest.approx({i: plain_best(by[i], ["alpha"]) or 0 for i in (1, 2, 3)})
    assert ranked("-beta") == {5: 0.0} and ranked("kind:x") == {1: 0.0, 3: 0.0, 5: 0.0} and ranked("gam*") == {1: 1.0, 3: 1.0} and ranked("übung_1") != {} and ranked("nothing") == {}
    assert ranked("beta && alpha") == pytest.approx({i: plain_best(by[i], ["beta"]) + plain_best(by[i], ["alpha"]) for i in (1, 3)})


def test_pages_of_the_most_relevant(spark, docs):
    index = ti.build_index(docs, "id", ["title", "body"])
    order = [r.id for r in ti.rank(docs, index, "beta", "id").orderBy(F.col("score").desc(), "id").collect()]
    pages = [[r.id for r in ti.search_ranked(docs.select("id"), index, "beta", "id", 2, k).collect()] for k in (0, 2)]
    assert list(itertools.chain(*pages)) == order


def test_an_index_of_nothing(spark, docs):
    index = ti.build_index(docs.limit(0), "id", ["title"])
    assert index.postings.collect() == [] and ti.rank(docs.limit(0), index, "beta", "id").collect() == []
    assert ti.rank(docs, index, "-beta", "id").count() == 5


def test_only_buckets_of_the_words_are_read(spark, docs, tmp_path):
    ti.write_index(ti.build_index(docs, "id", ["title", "body"]), str(tmp_path / "i"))
    plan = ti.read_index(spark, str(tmp_path / "i")).of_words(["beta"], [])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(term), EqualTo(term,beta)]" in plan
