"""CSV exports: UTF-8 with a byte-order mark, cells no spreadsheet takes for formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.operators import documents as D
from lexifold.operators import zipf as Z


def result_rows(documents: DataFrame, hits: DataFrame, numbers: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows of a search's export; pass every document with score 0 and its number as rank to export a library.

    ``counts`` are the documents' six counts, if an index holds them; else those of the hits are counted.
    """
    keys = ["collection_id", "id"]
    counts = D.counts(documents.join(hits.select(*keys), keys, "left_semi")) if counts is None else counts
    titles = documents.select("collection_id", "id", X.safe_csv("title").alias("title"), X.safe_csv("filename").alias("filename"))
    joined = hits.join(titles, keys).join(numbers, keys).join(counts, keys)
    return joined.select(
        "collection_id", "rank", "number", "id", "title", F.round("score", 6).alias("bm25"), "characters", "characters_no_space", "words", "sentences", "indexed_terms", "unique_terms", "filename"
    )


def vocabulary_rows(documents: DataFrame, condition: str) -> DataFrame:
    """rank, term, CF, DF and IDF of each topic."""
    terms = Z.ranked(Z.frequencies(documents, condition)).join(Z.sizes(documents), "collection_id")
    return terms.select("collection_id", "rank", X.safe_csv("term").alias("term"), "cf", "df", F.round(Z.idf(F.col("documents"), F.col("df")), 8).alias("idf"))


def distribution_rows(documents: DataFrame, numbers: DataFrame, value: str, condition: str) -> DataFrame:
    """number, document_id, title, term, TF of the documents that hold a term."""
    rows = Z.distribution(documents, numbers, value, condition)
    return rows.select("collection_id", "number", F.col("id").alias("document_id"), X.safe_csv("title").alias("title"), X.safe_csv("term").alias("term"), "tf")


def write(rows: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """One folder per topic of CSV parts, each with a header and the mark that tells spreadsheets it is UTF-8.

    A topic's parts follow ``order`` (its rank or number, where it has one) by name and inside.
    """
    order = order if order is not None else [c for c in ("rank", "number") if c in rows.columns][:1]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, "collection_id", *order).sortWithinPartitions("collection_id", *order) if order else rows
    first = rows.columns[0] if rows.columns[0] != "collection_id" else rows.columns[1]
    marked = placed.withColumnRenamed(first, "\ufeff" + first)
    marked.write.mode("overwrite").partitionBy("collection_id").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
