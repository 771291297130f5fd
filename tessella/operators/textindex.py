"""A positional index of text columns, sloppy phrases over it, and relevance of the query language's matches.

    postings: term, field, id, n_words (of that field), positions (from 0, ascending)
    lengths:  field, id, n_words

Words are runs of letters, digits and underscores, without case. Postings are one row for a word in a document's field, so a frequent word is
many rows, never one; what a query reads are the rows of its own words, found by bucket and by statistics of the sorted files.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.querystring import Compiler, Node, Parser, unescape, wild_pattern

WORD = r"[\p{L}\p{N}_]+"
#: The usual constants of the score, the slop of phrases and the share of a word's lesser fields.
K1, B, SLOP, TIE_BREAKER = 1.2, 0.75, 5, 0.3
#: Folders of a written index.
BUCKETS = 256


@dataclass
class TextIndex:
    postings: DataFrame
    lengths: DataFrame
    fields: tuple[str, ...]

    def of_words(self, words: list[str], patterns: list[str]) -> DataFrame:
        """The postings of the words and of those that match a pattern."""
        term = F.col("term")
        wanted = term.isin(words) if words else F.lit(False)
        for p in patterns:
            wanted = wanted | term.rlike(p)
        rows = self.postings.where(wanted)
        if "bucket" in rows.columns and not patterns:
            rows = rows.where(F.col("bucket").isin([r[0] for r in self.postings.sparkSession.createDataFrame([(w,) for w in words], "term string").select(_bucket()).collect()]))
        return rows


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"))


def build_index(docs: DataFrame, id_col: str, fields: list[str]) -> TextIndex:
    """Words are grouped within their document before they move: a document's rows are in one partition, so partial aggregation makes a
    posting of each. Null and empty texts have length 0 and no postings; ids are taken as unique."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col(f"`{f}`")).alias("words")) for f in fields])).alias("x")).select("id", "x.*", F.size("x.words").alias("n_words"))
    each = texts.select("field", "id", "n_words", F.posexplode("words").alias("position", "term"))
    postings = each.groupBy("term", "field", "id").agg(F.first("n_words").alias("n_words"), F.sort_array(F.collect_list("position")).alias("positions"))
    return TextIndex(postings, texts.select("field", "id", "n_words"), tuple(fields))


def write_index(index: TextIndex, path: str) -> None:
    """Postings in folders by hash of the word, sorted by word and id, so a query opens the folders of its words and skips most row groups."""
    dealt = index.postings.withColumn("bucket", _bucket()).repartitionByRange("bucket", "term", "field", "id").sortWithinPartitions("bucket", "term", "field", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    index.lengths.write.partitionBy("field").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    lengths = spark.read.parquet(f"{path}/lengths")
    return TextIndex(spark.read.parquet(f"{path}/postings"), lengths, tuple(sorted(r[0] for r in lengths.select("field").distinct().collect())))


def phrase_frequency(positions: list[Column], slop: int) -> Column:
    """How often words stand in the order and distance of a phrase, given the positions of each word: 0 if they never do within slop.

    Each word's place is its position less its offset in the phrase; the window of a place is the least span, backwards from it, that holds a
    place of every word, and counts 1 / (1 + span) if the span is within slop. One fold over the sorted places keeps the latest of
    each word. A word that stands twice in the phrase has to be found at two positions.
    """
    k = len(positions)

    def places_of(word: int) -> Column:
        return F.transform(positions[word], lambda x: F.struct((x - word).alias("q"), F.lit(word).alias("j")))

    places = F.sort_array(F.concat(*map(places_of, range(k))))
    start = F.struct(F.array(*[F.lit(None).cast("int")] * k).alias("last"), F.lit(0.0).alias("n"))

    def step(held: Column, place: Column) -> Column:
        last = F.transform(held["last"], lambda x, j: F.when(j == place["j"], place["q"]).otherwise(x))
        span = place["q"] - F.array_min(last)
        whole = F.forall(last, lambda x: x.isNotNull()) & (F.size(F.array_distinct(F.transform(last, lambda x, j: x + j))) == k)
        return F.struct(last.alias("last"), (held["n"] + F.when(whole & (span <= slop), 1.0 / (1.0 + span)).otherwise(0.0)).alias("n"))

    return F.aggregate(places, start, step)["n"]


def has_phrase(text: Column, phrase: str, slop: int) -> Column:
    """Whether a text holds the words of a phrase within slop, as an expression on the text itself. A text that lacks one of them is passed over at once."""
    words = phrase_words(phrase)
    if not words:
        return F.lit(False)
    found = words_of(text)
    at = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(words))
    places = [F.transform(F.filter(at, _is(w)), lambda x: x["i"]) for w in words]
    holds = reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(w)) for w in dict.fromkeys(words)])
    return F.when(holds, phrase_frequency(places, slop) > 0).otherwise(False)


def _is(word: str):
    return lambda x: x["w"] == word


def phrase_words(phrase: str) -> list[str]:
    return re.findall(r"\w+", phrase.lower())


class SloppyCompiler(Compiler):
    """The query language with phrases that allow for slop."""

    def __init__(self, schema, text_columns, slop: int):
        super().__init__(schema, text_columns)
        self.slop = slop

    def column(self, node: Node) -> Column:
        if node.kind != "phrase":
            return super().column(node)
        fields = [node.field] if node.field is not None else self.text
        tests = [self.over(f, lambda v, _: has_phrase(v.cast("string"), unescape(node.value[1:-1]), self.slop)) for f in fields]
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def search_slop(docs: DataFrame, query: str, text_columns: list[str] | None = None, slop: int = SLOP) -> DataFrame:
    """search() with phrases whose words may be moved by slop places in all, in any order. No index is needed; null texts match nothing."""
    return docs.where(SloppyCompiler(docs.schema, text_columns, slop).column(Parser(query).parse()))


class RankedCompiler(Compiler):
    """The query language with words and phrases looked up in columns of scores, null where there is no match."""

    def __init__(self, schema, leaves: list[Node]):
        super().__init__(schema, [])
        self.scored = {id(n): f"__s{k}" for k, n in enumerate(leaves)}

    def column(self, node: Node) -> Column:
        return F.col(self.scored[id(node)]).isNotNull() if id(node) in self.scored else super().column(node)


def _leaves(node: Node, fields: tuple[str, ...], negated: bool = False) -> list[tuple[Node, bool]]:
    """The words and phrases of a query that the index answers, each with whether it is only looked for to be left out."""
    if node.kind in ("term", "phrase"):
        return [(node, negated)] if node.field is None or node.field in fields else []
    return [x for p in node.parts for x in _leaves(p, fields, negated != (node.kind == "not"))]


def _needs(node: Node, scored: set[int]) -> bool:
    """Whether every match has a word or phrase of the index."""
    if node.kind == "or":
        return all(_needs(p, scored) for p in node.parts)
    return id(node) in scored or node.kind == "and" and any(_needs(p, scored) for p in node.parts)


def rank(docs: DataFrame, index: TextIndex, query: str, id_col: str, slop: int = SLOP) -> DataFrame:
    """The rows of docs that match query, with score, the relevance of its words and phrases.

    Words and phrases without a field, or of an indexed one, are answered by the index, everything else by the columns of docs; texts
    are not read again. A word scores its inverse document frequency ln(1 + (N - n + 0.5) / (n + 0.5)) times f (k1 + 1) / (f + k1 (1 - b + b length /
    mean length)) in its best field, and a share of TIE_BREAKER of that in its others; a phrase does so with the sum of its words' inverse
    frequencies and phrase_frequency(). A word with wildcards scores 1. Scores of all leaves add up; those under a negation count nothing, and a query of other tests
    alone scores 0.
    """
    tree = Parser(query).parse()
    leaves = _leaves(tree, index.fields)
    units = []
    for node, _ in leaves:
        text = unescape(node.value[1:-1]) if node.kind == "phrase" else node.value
        pattern = wild_pattern(text.lower()) if node.kind == "term" else None
        words = [] if pattern else phrase_words(text if node.kind == "phrase" else unescape(text))
        units.append((words, pattern, [node.field] if node.field else list(index.fields)))
    compiler = RankedCompiler(docs.schema, [n for n, _ in leaves])
    needed = _needs(tree, set(compiler.scored))
    scores = _leaf_scores(index, units, slop).withColumnRenamed("id", "__id")
    # a query whose matches all have an indexed word needs only the documents that the index names
    rows = docs.join(scores, F.col(f"`{id_col}`") == F.col("__id"), "inner" if needed else "left")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) for k, (_, negated) in enumerate(leaves) if not negated], F.lit(0.0))
    return rows.where(compiler.column(tree)).select(*[F.col(f"`{c}`") for c in docs.columns], total.alias("score"))


def _leaf_scores(index: TextIndex, units: list[tuple[list[str], str | None, list[str]]], slop: int) -> DataFrame:
    """id and one column __s<k> per unit: its score in the document, null without a match. Postings of the query's words meet by document, so
    a group holds no more rows than the query has words (or matches of wildcards) and fields."""
    words = sorted({w for u in units for w in u[0]})
    rows = index.of_words(words, [u[1] for u in units if u[1]])
    frequencies = {(r["field"], r["term"]): r["n"] for r in index.of_words(words, []).groupBy("field", "term").agg(F.count("*").alias("n")).collect()}
    sizes = {r["field"]: (r["n"], r["mean"] or 1.0) for r in index.lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("n_words").alias("mean")).collect()}

    def rarity(field: str, word: str) -> float:
        n = frequencies.get((field, word), 0)
        return math.log(1 + (sizes[field][0] - n + 0.5) / (n + 0.5)) if field in sizes else 0.0

    found = rows.groupBy("id").agg(F.collect_list(F.struct("field", "term", "n_words", "positions")).alias("found"))

    def in_field(unit: tuple, field: str) -> Column:
        own, pattern, _ = unit
        if pattern:
            return F.when(F.exists("found", lambda x: (x["field"] == field) & x["term"].rlike(pattern)), 1.0)
        if not own:
            return F.lit(None).cast("double")
        posting = lambda w: F.get(F.filter("found", lambda x: (x["field"] == field) & (x["term"] == w)), F.lit(0))
        hits = [posting(w) for w in own]
        f = F.size(hits[0]["positions"]).cast("double") if len(own) == 1 else phrase_frequency([h["positions"] for h in hits], slop)
        part = f * (K1 + 1) / (f + K1 * (1 - B + B * hits[0]["n_words"] / F.lit(sizes.get(field, (0, 1.0))[1])))
        whole = reduce(lambda a, b: a & b, [h.isNotNull() for h in hits])
        return F.when(whole, F.when(f > 0, part * sum(rarity(field, w) for w in own)))

    def score(unit: tuple) -> Column:
        each = F.filter(F.array(*[in_field(unit, f) for f in unit[2]]), lambda x: x.isNotNull())
        return F.when(F.size(each) > 0, F.array_max(each) * (1 - TIE_BREAKER) + TIE_BREAKER * F.aggregate(each, F.lit(0.0), lambda a, x: a + x))

    return found.select("id", *[score(u).alias(f"__s{k}") for k, u in enumerate(units)])


def search_ranked(docs: DataFrame, index: TextIndex, query: str, id_col: str, size: int = 10, offset: int = 0, slop: int = SLOP) -> DataFrame:
    """One page of rank(), the most relevant first and equal scores by id: each partition keeps its first offset + size rows, and those are merged."""
    return rank(docs, index, query, id_col, slop).orderBy(F.col("score").desc(), id_col).offset(offset).limit(size)
