"""Spelling suggestions by edit distance from each topic's vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.operators.index import whole_text


def edit_distance(left: Column, right: Column, most: int | None = None) -> Column:
    """Levenshtein distance of folded texts; ``most`` + 1 for any beyond ``most``."""
    a, b = X.fold(left), X.fold(right)
    if most is None:
        return F.levenshtein(a, b).cast("bigint")
    within = F.levenshtein(a, b, most)
    return F.when(within < 0, most + 1).otherwise(within).cast("bigint")


def vocabulary(documents: DataFrame) -> DataFrame:
    """collection_id, word, n: unstemmed words of letters that are no stop words, over abstract and body."""
    held = F.filter(X.without_stop_words(X.tokens("text")), lambda w: w.rlike(r"^\p{L}+$"))
    words = whole_text(documents).select("collection_id", F.explode(held).alias("word"))
    return words.groupBy("collection_id", "word").agg(F.count("*").alias("n"))


def candidates(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """collection_id, word, candidate, distance, n within one edit (words up to four letters) or two.

    ``words`` (collection_id, word) meets the vocabulary on the topic and the
    candidate's length, so only words of nearly one length are compared.
    """
    most = F.when(F.length("word") <= 4, 1).otherwise(2)
    asked = words.withColumn("most", most).withColumn("size", F.explode(F.sequence(F.length("word") - F.col("most"), F.length("word") + F.col("most"))))
    held = vocabulary.select("collection_id", F.col("word").alias("candidate"), "n", F.length("word").alias("size"))
    met = asked.join(held, ["collection_id", "size"]).withColumn("distance", F.levenshtein("word", "candidate", 2).cast("bigint"))  # -1 beyond 2
    return met.filter((F.col("distance") >= 0) & (F.col("distance") <= F.col("most"))).select("collection_id", "word", "candidate", "distance", "n")


def suggestions(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """collection_id, word, suggestion: the nearest, then most frequent, then smallest candidate.

    A word that is known, isn't all letters or has fewer than three, and one
    without candidate, stays as it is.
    """
    asked = words.select("collection_id", "word").distinct()
    unknown = asked.filter(F.col("word").rlike(r"^\p{L}{3,}$")).join(vocabulary, ["collection_id", "word"], "left_anti")
    order = Window.partitionBy("collection_id", "word").orderBy("distance", F.col("n").desc(), "candidate")
    best = candidates(unknown, vocabulary).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    best = best.select("collection_id", "word", F.col("candidate").alias("suggestion"))
    return asked.join(best, ["collection_id", "word"], "left").withColumn("suggestion", F.coalesce("suggestion", "word"))


def corrected(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """collection_id, query, corrected, changes of each query (collection_id, query); corrected is empty if nothing changes."""
    words = queries.select("collection_id", "query", F.posexplode(X.tokens("query")).alias("pos", "word"))
    fixed = words.join(suggestions(words, vocabulary), ["collection_id", "word"])
    whole = fixed.groupBy("collection_id", "query").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "suggestion"))).alias("w"))
    changed = F.filter("w", lambda x: x.word != x.suggestion)
    return whole.select(
        "collection_id", "query",
        F.when(F.size(changed) > 0, F.array_join(F.transform("w", lambda x: x.suggestion), " ")).otherwise("").alias("corrected"),
        F.array_join(F.transform(changed, lambda x: F.concat_ws(">", x.word, x.suggestion)), " ").alias("changes"),
    )
