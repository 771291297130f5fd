"""Token counts against the vocabulary's library; resampling and turn repair against plain readings of their rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SCHEMA, lower
from tessella.llm import token_count
from tessella.llm.importance import bucket_counts, resample
from tessella.llm.token_count import Merger, count_tokens, slice_counts
from tessella.llm.turn_repair import damage, digests, key_of, repair

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def merger():
    with open(VOCABULARY, "rb") as f:
        return Merger(f.read())


def test_token_counts_are_those_of_the_library(docs, corpus, library, clashing, empty):
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, *_ in corpus}
    for table in (docs, clashing):
        got = {r[0]: (r[1], r[2]) for r in count_tokens(table, VOCABULARY).select("doc_id", "n_bytes", "n_tokens").collect()}
        assert got == want
    assert {r[0] for r in count_tokens(docs, VOCABULARY, limit=300).where("over_limit").collect()} == {i for i, (_, n) in want.items() if n > 300}
    assert count_tokens(empty, VOCABULARY).collect() == []


def test_repeated_rows_and_null_ids_are_counted(spark):
    rows = [(None, "a b", "", "", 1), (7, "a b", "", "", 1), (7, "a b", "", "", 1), (8, None, "", "", 0)]
    got = Counter(map(tuple, count_tokens(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect()))
    assert got == {(None, 3, 2, False): 1, (7, 3, 2, False): 2, (8, 0, 0, False): 1}


PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", "'", "'s", " ", "  ", "\n", "\t", " ", "　", "\x1c", "1", "23", "½", "é", "é", "ß", "漢", "😀", ".", "!", "-", "<|endoftext|>", "<|endo", "R", "'S", "\r\n", "\U00010d4a", "\U000116d0", "​", "ing", "the"]


def test_any_mixture_of_characters_splits_like_the_library(merger, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    got = slice_counts(pa.array(texts, pa.large_string()), merger)
    assert got.tolist() == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_has_the_class_of_the_library(merger, library):
    texts = ["a" + "".join(chr(c) + "a1" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 64)]
    got = slice_counts(pa.array(texts, pa.large_string()), merger)
    assert got.tolist() == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, "the quick brown fox " * 70_000, " " * 90_000, "<|endoftext|>" * 20_000, "x" + " \n" * 200_000 + "y", "word<|endoftext|> more " * 60_000])
def test_long_texts_are_counted_whole(text, merger, library, monkeypatch):
    monkeypatch.setattr(token_count, "SEGMENT", 10_000)
    assert slice_counts(pa.array([text, "hello"], pa.large_string()), merger).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in (text, "hello")]


def test_a_full_memory_of_pieces_changes_nothing(merger, library, monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 3)
    text = "one two three four five six seven eight nine ten one two three"
    assert slice_counts(pa.array([text], pa.large_string()), merger).tolist() == [len(library.encode(text))]


def test_other_kinds_of_vocabulary_are_refused(spark, docs):
    with pytest.raises(ValueError, match="byte-level"):
        count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_resampling(rows, target, max_n=1, share=10, least=20):
    def runs(text):
        words = words_of(text)
        return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    raw, aim = Counter(bucket(x) for _, t in rows for x in runs(t)), Counter(bucket(x) for t in target for x in runs(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    out = []
    for i, text in rows:
        own = [gain(bucket(x)) for x in runs(text)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[4] >= least)
    rank = {x[3]: n + 1 for n, x in enumerate(able[: share * len(able) // 100])}
    return Counter((*r[:4], rank.get(k)) for k, r in enumerate(out))


TARGET = ["Ba ko ri TU benchmark", None, "", "hot copy of a text, hot copy", "école a b c"]


@pytest.mark.parametrize(("max_n", "share", "least"), [(1, 10, 20), (3, 50, 1), (2, 100, 0), (1, 0, 20)])
def test_resampling_is_that_of_the_rules(spark, docs, clashing, corpus, max_n, share, least):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = plain_resampling([(r[0], r[1]) for r in corpus], TARGET, max_n, share, least)
    for table in (docs, clashing):
        got = resample(table, target, share=share, min_words=least, max_n=max_n)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_odd_tables(spark, empty, docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert resample(empty, target).collect() == []
    assert not bucket_counts(empty).any()
    assert resample(docs, target.limit(0)).count() == docs.count()
    rows = [(None, "a b c", "", "", 1)] * 3 + [(4, "a b c", "", "", 1)] * 3 + [(5, None, "", "", 0)]
    got = resample(spark.createDataFrame(rows, SCHEMA), target, share=100, min_words=0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 8))
    assert Counter(r.doc_id for r in got) == Counter([None] * 3 + [4] * 3 + [5])


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, repeats as rows. Cheapest edits by trying all, from the last turn on."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, said, inserted):
        found = []
        if i == len(rows) and said in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for x in "ua":
                if x in after[said]:
                    cost, audit, text = best(i, x, inserted + 1)
                    found.append((cost + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[x], *text)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, rest = best(i + 1, said, 0)
            found.append((cost + 3, "D" + audit, rest))
            if faults[i] in ("", "truncated"):
                for x, name, own, letter in [(role[:1], role, 0, "K"), ("u", "user", 2, "R"), ("a", "assistant", 2, "R")]:
                    if x in after[said]:
                        cost, audit, rest = best(i + 1, after[said][x], 0)
                        found.append((cost + own + (faults[i] == "truncated"), letter + audit, (f"{name}:{text}", *rest)))
        return min(found, default=(10**9, "", ()))

    cost, audit, text = best(0, "", 0)
    n = Counter(faults)
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


TURNS = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, **options):
    fixed = repair(damage(spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("key", "chunk", "copies", "n", "kind")}).repartition(3)), copies_col="copies", **options)
    both = fixed.summary.join(digests(fixed.turns), "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r[0]: tuple(r)[1:] for r in both.collect()}


def some_conversations(rng, n, most, numbers):
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "User", "user", "assistant", "user", "assistant"]
    texts = ["Hello.", "Why?", "no end", "  \t", "", None, "Fine! \n", "Hello.", "école…", "A second line.\nAnd more"]
    return [(None if c == 0 else c, rng.choice(numbers), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize(("numbers", "most"), [(list(range(9)), 9), ([None, 0, 1, 1, 2, 63, 64, 65, 130, 1000, -5], 14), (list(range(500)), 90)])
def test_repairs_are_the_cheapest(spark, numbers, most):
    rows = some_conversations(random.Random(most), 120 if most < 50 else 25, most, numbers)
    want = {("" if c is None else f"={c}"): plain_repair(tuple(r)) for c, r in plain_damage(rows).items() if r}
    assert repaired(spark, rows) == want


def test_a_long_conversation_is_folded_in_a_tree(spark, monkeypatch):
    rng = random.Random(8)
    from tessella.llm import turn_repair

    monkeypatch.setattr(turn_repair, "CHUNK", 4)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {t}.", f"turn {t}", "again."])) for t in range(200)] + [(2, 0, "user", "Hi.")]
    want = {f"={c}": plain_repair(tuple(r)) for c, r in plain_damage(rows).items() if r}
    assert repaired(spark, rows) == want


def test_conversations_without_rows_and_repeated_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    fixed = repair(empty)
    assert fixed.summary.collect() == [] and digests(fixed.turns).collect() == []
    rows = [(5, 1, "user", "Hi.")] * 1000 + [(5, 2, "assistant", "Yes.")]
    fixed = repair(spark.createDataFrame(rows, TURNS))
    (row,) = fixed.summary.collect()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (999, 999, 999 * 3, "K" + "D" * 999 + "K")
    assert [(t.role, t.text) for r in fixed.turns.collect() for t in r.said] == [("user", "Hi."), ("assistant", "Yes.")]


def test_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("=",)], "c string")
    assert sorted(r[0] for r in rows.select(key_of(F.col("c"))).collect()) == ["", "=", "=="]
