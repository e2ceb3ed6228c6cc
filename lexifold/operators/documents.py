"""Documents of topics: which are held, how they are numbered, what they count.

Everything is kept apart by ``collection_id``: every key of a group, window or
join begins with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.operators import ranks
from lexifold.runtime import materialise


def uniform(articles: DataFrame) -> DataFrame:
    """Articles as documents: missing text is empty, a missing title ``(Untitled)``."""
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("abstract", "body", "filename", "doi", "journal")]
    title = F.when(X.strip(F.coalesce(F.col("title"), F.lit(""))) == "", "(Untitled)").otherwise(F.col("title")).alias("title")
    return articles.select("collection_id", F.col("article_id").alias("id"), "article_no", title, *filled)


def keep_first(documents: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The first of a topic's rows with one id, by arrival (``article_no``, unique).

    Only keys are shuffled to find the later rows: the first of each id is an aggregate,
    so an id that any part of all rows have is combined before it moves, and what is no
    first is told by its own number.  If the later rows are ``few`` (8 MB) they are sent to the
    texts, else both meet in a shuffle.
    """
    first = documents.groupBy("collection_id", "id").agg(F.min("article_no").alias("article_no"))
    later = materialise(documents.select("article_no").join(first.select("article_no"), "article_no", "left_anti"), "later")
    later = F.broadcast(later) if later.count() <= few else later
    return documents.join(later, "article_no", "left_anti").select(*documents.columns)


def active(articles: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents held by each topic: first deliveries that are not deleted."""
    gone = deleted.select("collection_id", F.col("article_id").alias("id")).distinct()
    return keep_first(uniform(articles).join(gone, ["collection_id", "id"], "left_anti"))


def numbered(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """collection_id, id, number: 1..N in each topic; stored numbers keep their order, new documents follow by arrival."""
    known = stored.select("collection_id", F.col("article_id").alias("id"), "doc_number").dropDuplicates(["collection_id", "id"])
    # Documents without a stored number follow all stored ones, stale ones among them, by arrival.
    placed = (
        documents.select("collection_id", "id", "article_no")
        .join(known, ["collection_id", "id"], "left")
        .withColumn("late", F.col("doc_number").isNull())
        .withColumn("place", F.coalesce("doc_number", "article_no"))
    )
    order = [F.col("late"), F.col("place"), F.col("id")]
    return ranks.ranked(placed, ["collection_id"], order, "number").select("collection_id", "id", "number")


def counts(documents: DataFrame) -> DataFrame:
    """The six counts of each document's abstract."""
    words = documents.withColumn("_t", X.tokens("abstract")).withColumn("_s", X.without_stop_words(F.col("_t")))
    return words.select(
        "collection_id",
        "id",
        F.length("abstract").cast("bigint").alias("characters"),
        F.length(F.regexp_replace("abstract", X.BLANK, "")).cast("bigint").alias("characters_no_space"),
        F.size("_t").cast("bigint").alias("words"),
        F.size(X.sentences("abstract")).cast("bigint").alias("sentences"),
        F.size("_s").cast("bigint").alias("indexed_terms"),
        F.size(F.array_distinct(_stems(F.col("_s")))).cast("bigint").alias("unique_terms"),
    )


def _stems(words):
    from lexifold.functions.porter import stems

    return stems(words)
