"""Boolean and phrase search with BM25 ranking inside each topic, answered from a written index.

A search reads the postings of its own terms only.  A posting carries its
document's length, so scores need no join with the documents; what a topic adds, its
number of documents and its frequencies, is one row for each topic and term.
Phrases are found by the terms' places.  No text is read and no Python runs.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexifold.functions import text as X
from lexifold.functions.porter import stem
from lexifold.operators import ranks
from lexifold.operators.index import Index

MODES = ("AND", "OR", "PHRASE")
K1, B = 1.2, 0.75
_TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W_]+(?:['’\-][^\W_]+)*")


def query_tokens(query: str) -> list[str]:
    return [t.lower().replace("ß", "ss") for t in _TOKEN.findall(query)]


def query_stems(query: str) -> list[str]:
    """Distinct stems of all the query's tokens, in order."""
    return list(dict.fromkeys(map(stem, query_tokens(query))))


def query_terms(query: str) -> list[str]:
    """Distinct stems of the query's tokens that are no stop words, in order."""
    return list(dict.fromkeys(stem(t) for t in query_tokens(query) if t not in X.STOP_WORDS))


def _weighted(own: DataFrame, topics: DataFrame) -> DataFrame:
    """Postings of a search with what each adds to its document's score."""
    frequencies = own.groupBy("collection_id", "term").agg(F.count("*").alias("df")).join(topics, "collection_id")
    n, df = F.col("documents"), F.col("df")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = frequencies.select("collection_id", "term", idf.alias("idf"), F.greatest(F.col("avg_length"), F.lit(1.0)).alias("usual"))
    norm = K1 * (1 - B + B * F.col("length") / F.col("usual"))
    added = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return own.join(weights, ["collection_id", "term"]).withColumn("added", added)


def scored(index: Index, terms: list[str]) -> DataFrame:
    """collection_id, id, score, matched: documents with any of the terms, their BM25 score and how many they hold."""
    own = index.postings.filter(F.col("term").isin(terms) & (F.col("tf") > 0)).select("collection_id", "term", "id", "tf", "length")
    return _weighted(own, index.topics).groupBy("collection_id", "id").agg(F.sum("added").alias("score"), F.count("*").alias("matched"))


def phrased(index: Index, phrase: list[str]) -> DataFrame:
    """collection_id, id of documents with a line that holds the stems in a row, stop words among them."""
    distinct = list(dict.fromkeys(phrase))
    own = index.postings.filter(F.col("term").isin(distinct)).select("collection_id", "term", "id", "places")
    at = [F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(f"at_{k}") for k, t in enumerate(distinct)]
    held = own.groupBy("collection_id", "id").agg(F.count("*").alias("n"), *at).filter(F.col("n") == len(distinct))
    places = [F.col(f"at_{distinct.index(t)}") for t in phrase]

    def follows(start):
        found = F.lit(True)
        for k, places_of in enumerate(places[1:], 1):
            found = found & F.array_contains(places_of, start + k)
        return found

    return held.filter(F.exists(places[0], follows)).select("collection_id", "id")


def hits(index: Index, query: str, mode: str = "AND", doc_id: str | None = None, unknown: str = "none") -> DataFrame:
    """collection_id, id, score, exact: a search's documents before they are ranked.

    ``doc_id`` narrows the hits to one id; counts stay those of the topic.  If no topic holds
    that id, ``unknown`` says what is found: "none", or "all" to search as without it.
    AND and OR find nothing for a query of stop words; PHRASE matches stop words too.
    """
    if mode not in MODES:
        raise ValueError("Unknown search mode")
    if unknown not in ("none", "all"):
        raise ValueError("unknown is none or all")
    terms = query_terms(query)
    rows = scored(index, terms)
    if mode == "PHRASE":
        phrase = [stem(t) for t in query_tokens(query)]
        found = phrased(index, phrase) if phrase else index.counts.select("collection_id", "id").limit(0)
        rows = found.join(rows, ["collection_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    elif mode == "AND":
        rows = rows.filter(F.col("matched") == len(terms)) if terms else rows.filter(F.lit(False))
    if doc_id is not None and not (unknown == "all" and not index.counts.filter(F.col("id") == doc_id).limit(1).count()):
        rows = rows.filter(F.col("id") == doc_id)
    return rows.select("collection_id", "id", F.round("score", 6).alias("score"), F.round("score", 9).alias("_exact"))


def search(index: Index, query: str, mode: str = "AND", doc_id: str | None = None, top: int | None = None, unknown: str = "none") -> DataFrame:
    """collection_id, id, score, rank of each topic's hits, best first, ties by id; the ``top`` first, if given."""
    found = hits(index, query, mode, doc_id, unknown)
    order = [F.col("_exact").desc(), F.col("id")]
    placed = ranks.ranked(found, ["collection_id"], order) if top is None else ranks.first_of(found, ["collection_id"], order, top)
    return placed.drop("_exact")


def term_table(index: Index, query: str, mode: str) -> DataFrame:
    """Each query stem's part in the search, its documents in the topic and its occurrences in the hits."""
    active = query_terms(query)
    wanted = document_counts(index, query)
    status = F.lit("phrase") if mode == "PHRASE" else F.when(F.col("term").isin(*active), "effective").otherwise("ignored")
    found = hits(index, query, mode).select("collection_id", "id", F.lit(1).alias("hit"))
    marked = wanted.join(found, ["collection_id", "id"], "left")
    of_hits = [F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ("tf_abstract", "tf_body", "tf_full")]
    return marked.groupBy("collection_id", "term").agg(F.count("*").alias("documents"), *of_hits).withColumn("status", status)


def document_counts(index: Index, query: str) -> DataFrame:
    """collection_id, id, term, tf_abstract, tf_body, tf_full of the query's stems."""
    own = index.postings.filter(F.col("term").isin(*query_stems(query)))
    return own.select("collection_id", "id", "term", "tf_abstract", "tf_body", (F.col("tf_abstract") + F.col("tf_body")).alias("tf_full"))


def _marked(text: str, wanted: set[str]) -> str:
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if stem(m.group().lower().replace("ß", "ss")) in wanted:
            out.append(f"{html.escape(text[at : m.start()])}<mark>{html.escape(m.group())}</mark>")
            at = m.end()
    return "".join(out) + html.escape(text[at:])


def highlight(query: str):
    """UDF: a text with every token whose stem is one of the query's in ``<mark>``, the rest escaped."""
    wanted = set(query_stems(query))

    @F.pandas_udf(T.StringType())
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _marked(t, wanted), na_action="ignore")

    return marked


def snippet(query: str, before: int = 100, length: int = 420):
    """UDF: the marked part of a text around its first hit."""
    wanted = set(query_stems(query))

    def cut(text: str) -> str:
        first = next((m.start() for m in _TOKEN.finditer(text) if stem(m.group().lower().replace("ß", "ss")) in wanted), 0)
        start = max(0, first - before)
        end = min(len(text), start + length)
        return ("…" if start else "") + _marked(text[start:end], wanted) + ("…" if end < len(text) else "")

    @F.pandas_udf(T.StringType())
    def snippets(texts: pd.Series) -> pd.Series:
        return texts.map(cut, na_action="ignore")

    return snippets


def library(documents: DataFrame, numbers: DataFrame, words: str = "", most: int = 200) -> DataFrame:
    """The first documents of each topic by number whose number, id and title hold all the words."""
    listed = documents.join(numbers, ["collection_id", "id"])
    shown = F.lower(F.concat_ws(" ", F.format_string("%03d", "number"), "id", "title"))
    for word in words.lower().split():
        listed = listed.filter(F.contains(shown, F.lit(word)))
    order = Window.partitionBy("collection_id").orderBy("number")
    return listed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("collection_id", "number", "id", "title")
