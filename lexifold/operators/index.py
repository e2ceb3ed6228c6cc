"""Inverted index: postings, document lengths, collection statistics; written once, read by every search.

Terms of a document are stemmed and counted in one Arrow batch beside its tokens,
so neither a vocabulary nor single tokens are shuffled.  A written index holds its
postings in ranges of (term, topic, id): a search's terms reach the scan as a
pushed filter and only files and row groups that hold them are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.functions.porter import occurrences, occurrences_by_part, stem, stems
from lexifold.runtime import materialise

_TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W_]+(?:['’\-][^\W_]+)*")


def whole_text(documents: DataFrame) -> DataFrame:
    """With ``text``: abstract and body on their own lines, empty ones left out."""
    parts = F.filter(F.array("abstract", "body"), lambda p: p != "")
    return documents.withColumn("text", F.array_join(parts, "\n"))


def with_terms(documents: DataFrame) -> DataFrame:
    """collection_id, id, terms: stems of the text's tokens that are no stop words."""
    return whole_text(documents).select("collection_id", "id", stems(X.without_stop_words(X.tokens("text"))).alias("terms"))


def postings(documents: DataFrame) -> DataFrame:
    """collection_id, term, id, tf."""
    return with_terms(documents).select("collection_id", "id", F.explode(occurrences("terms")).alias("term", "tf"))


def lengths(documents: DataFrame) -> DataFrame:
    """collection_id, id, length: number of indexed terms, 0 for a document without."""
    return whole_text(documents).select("collection_id", "id", F.size(X.without_stop_words(X.tokens("text"))).cast("bigint").alias("length"))


def statistics(documents: DataFrame) -> DataFrame:
    """collection_id, documents, avg_length."""
    return topics(lengths(documents))


def topics(held: DataFrame) -> DataFrame:
    return held.groupBy("collection_id").agg(F.count("*").alias("documents"), F.avg("length").alias("avg_length"))


def stem_frequencies(documents: DataFrame) -> DataFrame:
    """collection_id, id, term, tf_abstract, tf_body, tf_full: stems with stop words, by region."""
    parts = occurrences_by_part(stems(X.tokens("abstract")), stems(X.tokens("body")))
    each = documents.select("collection_id", "id", F.explode(parts).alias("term", "_n"))
    return each.select("collection_id", "id", "term", F.col("_n")[0].alias("tf_abstract"), F.col("_n")[1].alias("tf_body"), (F.col("_n")[0] + F.col("_n")[1]).alias("tf_full"))


# --- the written index -----------------------------------------------------------

ENTRIES = "collection_id string, term string, id string, tf bigint, tf_abstract bigint, tf_body bigint, length bigint, places array<int>"


@dataclass(frozen=True)
class Index:
    """Tables of a written index.

    postings: collection_id, term, id, tf (0 where only stop words have this stem),
    tf_abstract, tf_body (stop words counted), length of the document, places of the
    stem in the text, one more between two lines.  counts: the six counts of each
    document and its length.  topics: documents, avg_length.  words: the spelling vocabulary.
    """

    postings: DataFrame
    counts: DataFrame
    topics: DataFrame
    words: DataFrame


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map task: documents to their postings, and one row without term that holds a document's length."""
    stop = frozenset(X.STOP_WORDS)
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    kinds = (*[pa.string()] * 3, *[pa.int64()] * 4, pa.list_(pa.int32()))
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            batch = whole.slice(first, 500)
            out: list[list] = [[] for _ in names]
            for topic, id_, *parts in zip(*(batch.column(c).to_pylist() for c in ("collection_id", "id", "abstract", "body"))):
                held: dict[str, list] = {}
                at = length = 0
                for region, text in enumerate(parts, 1):
                    for line in _LINES.split(text):
                        for token in _TOKEN.findall(line):
                            folded = token.lower().replace("ß", "ss")
                            own = held.setdefault(stem(folded), [0, 0, 0, []])
                            if folded not in stop:
                                own[0] += 1
                                length += 1
                            own[region] += 1
                            own[3].append(at)
                            at += 1
                        at += 1
                for column, value in zip(out, (topic, None, id_, 0, 0, 0, length, [])):
                    column.append(value)
                for term, (tf, tf_abstract, tf_body, places) in held.items():
                    for column, value in zip(out, (topic, term, id_, tf, tf_abstract, tf_body, length, places)):
                        column.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names=names)


_LINES = re.compile(r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")


def write_index(documents: DataFrame, path: str) -> None:
    """Write the index of (collection_id, id, abstract, body, ...), whose texts aren't null, below ``path``."""
    from lexifold.operators.documents import counts
    from lexifold.operators.spelling import vocabulary

    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = materialise(documents.select("collection_id", "id", "abstract", "body").mapInArrow(entries, ENTRIES), "entries")
    keys = ["term", "collection_id", "id"]  # a term of any number of documents can lie across files
    placed = held.filter(F.col("term").isNotNull()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    lengths_ = held.filter(F.col("term").isNull()).select("collection_id", "id", "length")
    counts(documents).join(lengths_, ["collection_id", "id"]).write.parquet(f"{path}/counts")
    topics(spark.read.parquet(f"{path}/counts")).write.parquet(f"{path}/topics")
    vocabulary(documents).write.parquet(f"{path}/words")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts", "topics", "words")))
