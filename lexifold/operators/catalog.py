"""Topics and their bookkeeping: offsets, import counters, new and known records, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import ids as I
from lexifold.functions import text as X


def next_offsets(imports: DataFrame) -> DataFrame:
    """collection_id, source, query, next_offset: the furthest record read for each source and folded query."""
    query = X.fold(F.coalesce(F.col("query_text"), F.lit(""))).alias("query")
    end = F.coalesce(F.col("retstart"), F.lit(0)) + F.coalesce(F.col("downloaded"), F.lit(0))
    return imports.groupBy("collection_id", "source", query).agg(F.max(end).cast("bigint").alias("next_offset"))


def latest_queries(imports: DataFrame) -> DataFrame:
    """collection_id, default_query, source, source_queries: as the last import of each topic (and source) left them."""
    last = imports.groupBy("collection_id").agg(F.max_by(F.struct("query_text", "source"), F.struct("created_at", "import_no")).alias("l"))
    each = imports.filter(F.col("source").isNotNull()).groupBy("collection_id", "source").agg(F.max_by("query_text", F.struct("created_at", "import_no")).alias("q"))
    maps = each.groupBy("collection_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "q")))).alias("source_queries"))
    return last.select("collection_id", F.col("l.query_text").alias("default_query"), F.col("l.source").alias("source")).join(maps, "collection_id", "left")


def import_report(imports: DataFrame) -> DataFrame:
    """Sums of each topic's and source's imports, and the records they didn't bring."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("requested", "downloaded", "added")]
    return imports.groupBy("collection_id", "source").agg(F.count("*").alias("imports"), *sums).select(
        "*", (F.col("requested") - F.col("downloaded")).alias("not_found"), (F.col("downloaded") - F.col("added")).alias("dropped")
    )


def known_ids(documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """collection_id, id held or deleted."""
    gone = deleted.select("collection_id", F.col("article_id").alias("id"))
    return documents.select("collection_id", "id").union(gone).distinct()


def new_records(batch: DataFrame, known: DataFrame) -> DataFrame:
    """A batch's first rows, by ``article_no`` (unique), with an abstract whose ids the topic doesn't know."""
    usable = batch.filter(X.strip("abstract") != "")
    keys = ["collection_id", "id", "article_no"]
    first = usable.groupBy("collection_id", "id").agg(F.min("article_no").alias("article_no"))
    first = usable.join(first.select("article_no"), "article_no", "left_semi").dropDuplicates(keys).select(*batch.columns)
    return first.join(known, ["collection_id", "id"], "left_anti")


def gated_files(batch: DataFrame, known: DataFrame) -> DataFrame:
    """collection_id, filename, records, accepted: a file is taken whole, or not at all if an id is known or repeated in it."""
    seen = batch.join(known.withColumn("_k", F.lit(1)), ["collection_id", "id"], "left")
    ids = seen.groupBy("collection_id", "filename", "id").agg(F.count("*").alias("n"), F.max("_k").alias("k"))
    return ids.groupBy("collection_id", "filename").agg(
        F.sum("n").alias("records"), ((F.max("n") == 1) & F.max("k").isNull()).alias("accepted")
    )


def parsed_batch(batches: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, pmid: distinct ids of each pasted list in order of first appearance; lists with an invalid piece or none are left out."""
    pieces = batches.select(key, F.posexplode(I.batch(column)).alias("at", "piece"))
    pieces = pieces.withColumn("bad", (~F.col("piece").rlike("^[1-9][0-9]*$")).cast("int")).withColumn("bad", F.max("bad").over(Window.partitionBy(key)))
    first = pieces.filter("bad = 0").groupBy(key, F.col("piece").alias("pmid")).agg(F.min("at").alias("at"), F.count("*").alias("times"))
    order = Window.partitionBy(key).orderBy("at")
    return first.select(key, F.row_number().over(order).cast("bigint").alias("pos"), "pmid", F.col("times").cast("bigint").alias("times"))


def fetch_report(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """collection_id, requested, returned, usable, not_found, without_abstract of ids asked for and records received."""
    asked = requested.select("collection_id", "id").distinct()
    got = returned.groupBy("collection_id", "id").agg(F.max((X.strip("abstract") != "").cast("int")).alias("usable"))
    met = asked.join(got, ["collection_id", "id"], "left")
    return met.groupBy("collection_id").agg(
        F.count("*").alias("requested"),
        F.count("usable").alias("returned"),
        F.count_if(F.col("usable") == 1).alias("usable"),
        F.count_if(F.col("usable").isNull()).alias("not_found"),
        F.count_if(F.col("usable") == 0).alias("without_abstract"),
    )


def created(topics: DataFrame, title: str, query: str = "", source: str = "pubmed") -> DataFrame:
    """The catalogue with a new topic; a ValueError for a title of no or over 80 characters, or one already there."""
    spark = topics.sparkSession
    tidy = " ".join(title.split())
    if not 1 <= len(tidy) <= 80:
        raise ValueError("a title has 1 to 80 characters")
    if topics.filter(X.fold(I.tidy_title("title")) == F.lit(tidy.lower().replace("ß", "ss"))).limit(1).count():
        raise ValueError("there is a topic of this title")
    row = spark.createDataFrame([(tidy, query.strip(), source)], "title string, default_query string, source string").select(
        I.slug("title").alias("collection_id"), "title", "default_query", "source", F.create_map("source", "default_query").alias("source_queries"),
        F.current_timestamp().alias("created_at"), F.lit(0).alias("document_count"),
    )
    return topics.unionByName(row.select(*topics.columns))


def recounted(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """The catalogue with the number of documents each topic holds."""
    held = documents.groupBy("collection_id").agg(F.count("*").cast("int").alias("_n"))
    return topics.join(held, "collection_id", "left").withColumn("document_count", F.coalesce("_n", F.lit(0))).select(*topics.columns)


def without(table: DataFrame, collection_id: str) -> DataFrame:
    """A table without a topic's rows."""
    return table.filter(F.col("collection_id") != collection_id)


def deletion(documents: DataFrame, collection_id: str, document_id: str) -> DataFrame:
    """The row to append to the deletions; a ValueError for a document that isn't held."""
    found = documents.filter((F.col("collection_id") == collection_id) & (F.col("id") == document_id)).limit(1)
    if not found.count():
        raise ValueError("there is no such document")
    return found.select("collection_id", F.col("id").alias("article_id"), F.current_timestamp().alias("deleted_at"))


def listed(topics: DataFrame) -> DataFrame:
    """id, title, query, source, source_queries, count of each topic, missing ones filled."""
    query = F.coalesce("default_query", F.lit(""))
    source = F.coalesce("source", F.lit("pubmed"))
    count = F.coalesce("document_count", F.lit(0))
    return topics.select(F.col("collection_id").alias("id"), "title", query.alias("query"), source.alias("source"), F.coalesce("source_queries", F.create_map(source, query)).alias("source_queries"), count.alias("count"))


def topic(topics: DataFrame, collection_id: str) -> DataFrame:
    """The topic's row, if there is one."""
    return topics.filter(F.col("collection_id") == collection_id)


def exists(topics: DataFrame, collection_id: str) -> bool:
    return bool(topic(topics, collection_id).limit(1).count())


def first_id(topics: DataFrame) -> str | None:
    """The topic that was created first; ties to the smaller id; None without topics."""
    found = topics.select(F.min(F.struct(F.col("created_at").isNull(), "created_at", "collection_id")).alias("f")).first()[0]
    return found and found[2]


def active_topic(topics: DataFrame, wanted: str | None = None) -> str | None:
    """The topic wanted, where it exists; else the first."""
    return wanted if wanted is not None and exists(topics, wanted) else first_id(topics)


def batch_report(batches: DataFrame, key: str, column: str, kind: str = "pmid", most: int = 200) -> DataFrame:
    """key, ids, duplicates, error of each pasted list: empty, the first invalid piece, or more than ``most`` different ids.

    A list with an error has no ids.
    """
    pieces = F.posexplode_outer(I.batch(column, kind))
    each = batches.select(key, pieces.alias("at", "piece")).withColumn("id", F.col("piece") if kind == "pmid" else I.arxiv("piece"))
    bad = F.col("piece").isNotNull() & (~F.col("piece").rlike("^[1-9][0-9]*$") if kind == "pmid" else F.col("id").isNull())
    listed_ = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id"))))  # no more than the list holds
    joined = each.groupBy(key).agg(F.count("piece").alias("pieces"), F.min(F.when(bad, F.struct("at", "piece"))).alias("bad"), F.array_distinct(F.transform(listed_, lambda x: x.id)).alias("ids"))
    joined = joined.withColumn("n", F.size("ids"))
    error = F.when(F.col("pieces") == 0, "empty").when(F.col("bad").isNotNull(), F.concat(F.lit("invalid: "), F.col("bad.piece"))).when(F.col("n") > most, f"more than {most}")
    joined = joined.withColumn("error", error)
    fine = F.col("error").isNull()
    return joined.select(key, F.when(fine, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("ids"), F.when(fine, F.col("pieces") - F.col("n")).otherwise(0).cast("bigint").alias("duplicates"), "error")
