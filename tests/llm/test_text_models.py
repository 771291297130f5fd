import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity

from .conftest import SCHEMA, prose


def crc(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    good = [a + b for a in ("ba", "ko", "ri", "tu") for b in ("ran", "lit", "ven", "dor", "pas")]
    slurs = ["grobnik", "grobnar", "grobnol", "grobnit", "idiot", "moron"]
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 80), good).split()
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(slurs)
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "!!! ...", "en", "s", 0), (903, "word " * 50_000, "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("module", "column", "held"), [(quality, "quality", (4, 2)), (toxicity, "toxic", (5, 0))])
def test_held_out_accuracy_and_odd_rows(labelled, module, column, held):
    docs, labels, truth = labelled
    model = module.fit(docs, labels.select("doc_id", F.col(column).alias("label")), held_out=held)
    got = module.score(docs.withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash")), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == truth[r.doc_id][column == "toxic"] for r in got if r.doc_id in truth and crc(r.doc_id, held[0]) == held[1]]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1


@pytest.mark.parametrize(("module", "held"), [(quality, (4, 2)), (toxicity, (5, 0))])
def test_held_out_labels_teach_nothing(labelled, module, held):
    docs, labels, _ = labelled
    small = docs.where("doc_id < 300")
    one = labels.select("doc_id", F.col("toxic").alias("label"))
    held_rows = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held[0])) == held[1]
    other = one.withColumn("label", F.when(held_rows, 1 - F.col("label")).otherwise(F.col("label")))
    scores = [{(r.doc_id, round(r.score, 9)) for r in module.score(small, module.fit(small, x, held_out=held)).collect()} for x in (one, other)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_empty_tables(spark, empty, module):
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "a calm and friendly line"), (3, None)], "doc_id long, text string")
    assert module.score(empty, module.fit(empty, none)).collect() == []
    got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, none)).collect()}
    assert set(got) == {1, 2, 3}
    if module is toxicity:
        assert got[1] > got[2]
    null_label = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, label int")
    assert len(module.score(docs, module.fit(docs, null_label)).collect()) == 3


def test_label_model_finds_accuracies_of_dependent_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    fire = lambda hit, false: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false)
    good, twin, other = fire(0.8, 0.02), None, fire(0.6, 0.05)
    twin = np.where(rng.random(len(y)) < 0.95, good, fire(0.8, 0.02))
    bits = np.zeros((len(y), len(toxicity.VOTERS)), dtype=int)
    bits[:, 0], bits[:, 1], bits[:, 4] = good, twin, other
    patterns, counts = np.unique(bits @ (1 << np.arange(bits.shape[1])), return_counts=True)
    model = toxicity.LabelModel(patterns, np.full(len(patterns), -1), counts)
    assert abs(model.prior[1] - 0.2) < 0.08
    q = model.posterior(bits @ (1 << np.arange(bits.shape[1])), np.full(len(y), -1))
    assert np.mean((q > 0.5) == y) > 0.93


def test_votes_and_probabilities_match_a_plain_reading():
    """Every voter and every feature of the linear model, word by word."""
    import re

    import pyarrow as pa

    rng = random.Random(6)
    pool = ["idiot", "IDIOTA", "crétin,", "trottel!", "scum", "bitch", "kill", "die", "1d10t", "st*p*d", "f**k", "grobnik", "grobnar", "grobnaz", "grobless", "calm", "line", "WORD", "You", "are", "...", "wow!", "mor0n"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, n))) for n in (3, 8, 20, 90) for _ in range(60)] + [None, "", "you are an idiot"]
    texts = [t if t is None or k % 3 else "calm line " * rng.randrange(40) + t for k, t in enumerate(texts)]
    hashed = lambda words: toxicity.table_features(pa.array(words, pa.large_string()))[0]
    word, begin = hashed(["grobnik"])[0][0], hashed(["grobnar"])[0][1:] + toxicity.DIMS
    lex = toxicity.Lexicons(np.array([word]), np.sort(begin), np.unique(np.concatenate([hashed(["idiot", "calm"])[:, 0], begin])))
    model = toxicity.ToxicityModel(lex, np.linspace(-1, 1, len(lex.features)), np.linspace(-0.5, 0.7, len(toxicity.VOTERS)), -0.3)

    def plain(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        norm = [w.lower().strip(toxicity.TRIM) for w in words]
        ids = [[-1 if x < 0 else int(x) + (toxicity.DIMS if k else 0) for k, x in enumerate(hashed([w])[0])] for w in words]
        own = {k: [w in v for w in norm] for k, v in toxicity.WORDS.items()}
        insult = [w in toxicity.INSULTS for w in norm]
        hidden = [not i and bool(re.search("[013457@$]", w)) and w.translate(toxicity.LEET) in toxicity.INSULTS for w, i in zip(norm, insult)]
        masked = [bool(re.search(toxicity.MASKED, w)) for w in norm]
        learned = [i[0] == word for i in ids]
        begins = [[i[k] in begin for i in ids] for k in (1, 2, 3)]
        abuse = [any(x) for x in zip(insult, hidden, masked, learned, *begins)]
        kinds = lambda flags: len({w for w, f in zip(words, flags) if f})
        directed = any(w.strip(toxicity.TRIM) in toxicity.INSULTS for m in toxicity.DIRECTED.finditer((text or "").lower()) for w in m[0].split()) and any(insult)
        n = max(len(words), 1)
        bits = [any(own[k]) for k in toxicity.VOTERS[:6]]
        bits += [kinds(own["threatening"]) > 1, kinds(insult) > 1, sum(insult) > kinds(insult), any(hidden), any(masked), directed, any(learned), kinds(learned) > 1]
        bits += [kinds(b) > 1 for b in begins] + [sum(abuse) / n > 0.01, any(abuse[:30]), any(abuse) and len(words) < 60]
        bits += [sum(w.isupper() and len(w) > 2 for w in words) / n > 0.5, sum("!" in w for w in words) / n > 0.1]
        z = model.bias + sum(v for v, b in zip(model.vote_weights, bits, strict=True) if b)
        z += sum(w for f, w in zip(lex.features, model.weights) if any(int(f) in i for i in ids))
        return sum(int(b) << k for k, b in enumerate(bits)), 1 / (1 + np.exp(-z))

    table = pa.array(texts, pa.string())
    got = np.concatenate([toxicity.votes(part, *rest, lex) for _, part, *rest in toxicity.words_of(table)])
    want = [plain(t) for t in texts]
    assert got.tolist() == [v for v, _ in want]
    assert np.allclose(toxicity.probabilities(table, model), [p for _, p in want])
    assert all(any(v >> k & 1 for v, _ in want) for k in range(len(toxicity.VOTERS)) if toxicity.VOTERS[k] not in ("learned_words",))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_text_ids_and_repeated_ids(spark, module):
    docs = spark.createDataFrame([(f"d{k}", ("you idiot moron " if k % 3 == 0 else "a calm line of text ") * (k % 5 + 1)) for k in range(90)] * 2 + [("d1", "another text"), (None, "x")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", int(k % 3 == 0)) for k in range(90)] + [(None, 1), ("none", 0)], "doc_id string, label int")
    scores = []
    for parts in (1, 7):
        got = module.score(docs, module.fit(docs.repartition(parts), labels)).collect()
        assert len(got) == docs.count()
        scores.append({(str(r.doc_id), round(r.score, 6)) for r in got})
    assert scores[0] == scores[1]


def test_pooled_vectors_and_network_match_plain_loops():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.ROWS, quality.WIDTH))
    texts = pa.array(["a b c b", None, "d", "a A!! a 12", "", "x " * 500])
    got = quality.pooled(texts, vectors, len(texts))
    for at, n, offsets, tokens in quality.streams(texts):
        for i in range(n):
            own = tokens[offsets[i] : offsets[i + 1]]
            want = [*(sum(vectors[t] for t in own) / len(own)), np.log1p(len(own)) / 8] if len(own) else np.zeros(quality.WIDTH + 1)
            assert np.allclose(got[at + i], want)
    net = quality.train(rng.normal(size=(80, 3)), (rng.random(80) < 0.5).astype(float), hidden=4, epochs=3)
    x = rng.normal(size=3)
    hidden = [np.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, h] for i in range(3)) + net.b1[h]) for h in range(4)]
    logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
    assert np.isclose(net.probability(x[None])[0], 1 / (1 + np.exp(-logit / net.temperature)))


def test_network_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y)
    p = net.probability(x)
    for low in (0.1, 0.4, 0.7):
        own = (p > low) & (p < low + 0.2)
        assert abs(y[own].mean() - p[own].mean()) < 0.1


def test_context_sums_match_a_plain_loop():
    import pyarrow as pa

    texts = pa.array(["a b c b", None, "d", "a A!! a", ""])
    got = np.zeros(quality.ROWS * quality.WIDTH)
    quality.context_sums(texts, got)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.WIDTH))
    for _, n, offsets, tokens in quality.streams(texts):
        for i in range(n):
            own = tokens[offsets[i] : offsets[i + 1]]
            for a in range(len(own)):
                for b in range(max(0, a - quality.WINDOW), min(len(own), a + quality.WINDOW + 1)):
                    if a != b:
                        for k in range(quality.NONZERO):
                            want[own[a], place[own[b], k]] += sign[own[b], k]
    assert np.allclose(got.reshape(want.shape), want)
