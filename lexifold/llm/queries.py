"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions.text import BLANK
from lexifold.llm import bpe, burst, distinctive, markup, mixing, neardup, perplexity, repetition, sentences
from lexifold.runtime import load


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "articles").filter("text_state = 'parsed'")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    counted, n = burst.count_terms(_parsed(spark, folder), ["abstract"])
    return banded(counted, n)


def banded(counted: DataFrame, n: int, rare: int = 3, common: float = 1 / 8) -> DataFrame:
    """Terms with their band: rare below ``rare`` records, common from the part ``common`` of the records with a term on."""
    band = F.when(F.col("records") < rare, "rare").when(F.col("records") >= n * common, "common").otherwise("useful")
    return counted.withColumn("band", band)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).filter("band <> 'useful'").select("term", "band")


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(_parsed(spark, folder), "article_no", ["abstract", "body"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = sentences.sentences(_parsed(spark, folder), "article_no", ["abstract", "body"], whole=False)
    return found.select("article_no", "part", "start_pos", "end_pos")


def _links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    articles = load(spark, folder, "articles").filter(F.col("abstract").rlike("[^" + BLANK[1:]))  # ends at the first sign that isn't blank
    return neardup.links(articles, "article_no", ["title", "abstract"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.expanded(*_links(spark, folder))
    return pairs.select(F.col("x").alias("article_no_a"), F.col("y").alias("article_no_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per article; one without abstract or shingles is a group of its own."""
    grouped = neardup.groups(*_links(spark, folder)).withColumnRenamed("id", "article_no")
    every = load(spark, folder, "articles").select("article_no").distinct().join(grouped, "article_no", "left")
    return every.select("article_no", F.coalesce("group", "article_no").alias("group"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.distinctive_terms(_parsed(spark, folder), "article_no", ["abstract", "body"]).select("article_no", "term")


def p5_log_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.distinctive_terms(_parsed(spark, folder), "article_no", ["abstract", "body"], by="log_likelihood", top=None, least_records=1)


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    received = load(spark, folder, "articles").filter("text_state = 'as_received'")
    return markup.clean_fields(received, "article_no", ["abstract", "body"])


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, folder).select("article_no", "part", "family", "clean_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.struct(F.lit("any").alias("elem"), F.lit(0).cast("bigint").alias("elem_no"), F.lit("").alias("clean_text"))
    marked = _fields(spark, folder).filter(F.col("family").isNotNull())
    return marked.select("article_no", "part", F.inline(F.concat(F.array(mark), F.col("elements"))))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(load(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))


def p8_chosen(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(load(spark, folder, "documents"), load(spark, folder, "mix_targets"))[1]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(load(spark, folder, "documents")).withColumn("share", F.round("share", 6))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(load(spark, folder, "documents")).filter(10 * F.col("n_repeated") >= 3 * F.col("n_letters")).filter("n_letters > 0").select("doc_id")


def p9_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.perplexity(load(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_sentences, p3_found, p3_groups, p5_found, p5_log_likelihood, p6_found, p6_clean, p7_ids, p8_found, p8_chosen, p8_shares, p9_found, p9_shares, p9_perplexity)
}
