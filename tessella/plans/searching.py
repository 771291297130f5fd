"""Registered queries of the positional index: sloppy phrases and ranked matches over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import textindex
from tessella.plans.registry import query, table

WORDS = r"w AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents))"


def _phrase_sql(first: str, second: str) -> str:
    """doc_id and how often a phrase of two words is found within slop 5."""
    return f"""SELECT doc_id, sum(1.0 / (1 + q - least(a, b))) AS f FROM (
            SELECT doc_id, q, last_value(CASE WHEN j = 0 THEN q END IGNORE NULLS) OVER o AS a, last_value(CASE WHEN j = 1 THEN q END IGNORE NULLS) OVER o AS b
            FROM (SELECT doc_id, p - j AS q, j FROM w JOIN (VALUES ('{first}', 0), ('{second}', 1)) v(term, j) USING (term)) WINDOW o AS (PARTITION BY doc_id ORDER BY q, j ROWS UNBOUNDED PRECEDING))
        WHERE a IS NOT NULL AND b IS NOT NULL AND q - least(a, b) <= 5 GROUP BY doc_id"""


@query(f"WITH {WORDS} SELECT doc_id FROM ({_phrase_sql('the', 'of')}) JOIN documents USING (doc_id) WHERE lang = 'en'")
def search_slop(spark, sf_dir):
    return textindex.search_slop(table(spark, sf_dir, "documents"), '"the of" lang:en', ["text"]).select("doc_id")


@query(f"WITH {WORDS} SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n, CAST(sum(p) AS BIGINT) AS positions FROM w GROUP BY term")
def text_postings(spark, sf_dir):
    """What the positional index of all documents holds of each word."""
    index = textindex.build_index(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return index.postings.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("positions"))


def _score_sql() -> str:
    share = lambda f, rarity: f"{rarity} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * n_words / mean))"
    rarity = lambda word: f"(SELECT ln(1 + (n - x + 0.5) / (x + 0.5)) FROM (SELECT count(DISTINCT doc_id) AS x FROM w WHERE term = '{word}'), z)"
    return f"""WITH {WORDS}, c AS (SELECT doc_id, lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS n_words FROM documents), z AS (SELECT count(*) AS n, avg(n_words) AS mean FROM c),
        a AS ({_phrase_sql("the", "of")}), b AS (SELECT doc_id, count(*) AS f FROM w WHERE term = 'was' GROUP BY doc_id)
        SELECT c.doc_id, round(coalesce({share("a.f", f"({rarity('the')} + {rarity('of')})")}, 0) + coalesce({share("b.f", rarity("was"))}, 0), 6) AS score
        FROM c JOIN z ON TRUE LEFT JOIN a ON a.doc_id = c.doc_id LEFT JOIN b ON b.doc_id = c.doc_id
        WHERE (a.f IS NOT NULL OR b.f IS NOT NULL) AND lang <> 'fr' AND c.doc_id NOT IN (SELECT doc_id FROM w WHERE term = 'der')"""


RANKED = '("the of" || was) -der !lang:fr'


def _ranking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang"), textindex.build_index(docs, "doc_id", ["text"])


@query(_score_sql())
def search_scores(spark, sf_dir):
    """Relevance of all matches of a query with a sloppy phrase, a word, a word to leave out and a plain column."""
    return textindex.rank(*_ranking(spark, sf_dir), RANKED, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, score FROM ({_score_sql()}) ORDER BY score DESC, doc_id LIMIT 25 OFFSET 5")
def search_ranked(spark, sf_dir):
    """A page of the most relevant matches."""
    return textindex.search_ranked(*_ranking(spark, sf_dir), RANKED, "doc_id", size=25, offset=5).select("doc_id", F.round("score", 6).alias("score"))
