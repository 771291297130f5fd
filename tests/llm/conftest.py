import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [a + b for a in ("ba", "ko", "ri", "tu", "me", "so") for b in ("ran", "lit", "ven", "dor", "pas", "nu")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows with null, empty, blank, short, very long, equal, near-equal and repeated texts."""
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "one", "two words", "One", "ÉCOLE a b c d e f", "école a b c d e f"]
    base = prose(rng, 200)
    words = base.split()
    texts += [base, base.upper(), base]
    for k in (1, 2, 3, 30):
        near = list(words)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"new{rng.randrange(99)}"
        texts.append(" ".join(near))
    texts += [prose(rng, n) for n in (4, 5, 6, 20, 60, 150, 300)]
    long = prose(rng, 30_000)
    texts += [long, long + " end", "hot copy of a text that many rows share " * 3]
    texts += ["hot copy of a text that many rows share " * 3] * 40
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    """The same documents with more columns, named like internal and result columns."""
    from pyspark.sql import functions as F

    names = ["uid", "norm", "ids", "size", "gkey", "shard", "slot", "digest", "n", "root", "block", "score", "batch", "__cell", "__hash", "__salt", "__bucket", "__bits", "__drop", "__hit", "pattern", "label", "kept"]
    return spark.createDataFrame(corpus, SCHEMA).withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
