"""Imports as transactions: fetch, drop what is known, stage, publish, log, undo.

A topic store is a folder of tables: ``topics``, ``documents`` (batches that are
published whole), ``imports`` (the log), ``deleted``.  A step that fails takes the ones
before it back, so a topic shows an import with its log entry or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.operators import catalog as C
from lexifold.runtime import materialise
from lexifold.sinks import state as S

DOCUMENTS = "collection_id string, id string, article_no bigint, title string, abstract string, body string, doi string, journal string, filename string"
IMPORTS = "import_no bigint, collection_id string, source string, query_text string, requested int, downloaded int, added int, retstart int, created_at timestamp"
DELETED = "collection_id string, article_id string, deleted_at timestamp"


@dataclass(frozen=True)
class Store:
    """A folder of state tables; one that doesn't exist yet is empty."""

    spark: SparkSession
    folder: str

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = files.exists(path) and any(not s.getPath().getName().startswith("_") for s in files.listStatus(path))
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.read.parquet(path.toString()).select(*names) if there else self.spark.createDataFrame([], schema)

    documents = property(lambda self: self._table("documents", DOCUMENTS))
    imports = property(lambda self: self._table("imports", IMPORTS))
    deleted = property(lambda self: self._table("deleted", DELETED))


def _taken(store: Store, topic: str, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a fetch brought, and of it the topic's new documents, both written aside."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in fetched.columns else F.lit("").alias(c) for c in ("title", "abstract", "body", "doi", "journal", "filename")]
    number = F.col("article_no") if "article_no" in fetched.columns else F.monotonically_increasing_id()
    batch = materialise(fetched.select(F.lit(topic).alias("collection_id"), "id", number.cast("bigint").alias("article_no"), *columns), "batch")
    own = lambda df: df.filter(F.col("collection_id") == topic)
    known = C.known_ids(own(store.documents), own(store.deleted))
    return batch, materialise(C.new_records(batch, known).select(*[c.split()[0] for c in DOCUMENTS.split(", ")]), "staged")


def ingest(store: Store, topic: str, source: str, query: str, fetch: Callable[[str, int, int], DataFrame], count: int = 500) -> dict:
    """One import of a query's next records: what was requested, downloaded and added, and from where.

    ``fetch(query, count, offset)`` gives rows with ``id`` and document columns.  The
    offset follows on the topic's last import of the same source and query.  A
    ValueError if nothing comes back.
    """
    folded = query.strip().lower().replace("ß", "ss")
    offsets = C.next_offsets(store.imports.filter((F.col("collection_id") == topic) & (F.col("source") == source)))
    last = offsets.filter(F.col("query") == folded).first()
    offset = last.next_offset if last else 0
    batch, new = _taken(store, topic, fetch(query, count, offset))
    downloaded, added = batch.count(), new.count()
    if not downloaded:
        raise ValueError("the service returned no records")
    published = S.publish(new, f"{store.folder}/documents")
    try:
        held = store.documents.filter(F.col("collection_id") == topic).select("id")
        if new.join(held, "id", "left_anti").limit(1).count():
            raise OSError("new documents are missing")
        number = (store.imports.agg(F.max("import_no")).first()[0] or 0) + 1
        row = store.spark.createDataFrame([(number, topic, source, query.strip(), count, downloaded, added, offset)], IMPORTS.rpartition(",")[0])
        S.append(row.withColumn("created_at", F.current_timestamp()), f"{store.folder}/imports")
    except Exception:
        S.withdraw(store.spark, published)
        raise
    return {"requested": count, "downloaded": downloaded, "added": added, "retstart": offset}


def ingest_ids(store: Store, topic: str, ids: DataFrame, fetched: DataFrame) -> dict:
    """An import of records asked for by id (id), which isn't logged: requested, returned, usable, not_found, without_abstract, added."""
    batch, new = _taken(store, topic, fetched)
    asked = ids.select(F.lit(topic).alias("collection_id"), "id")
    report = C.fetch_report(asked, batch).first()
    if report is None or not report.usable:
        raise ValueError("none of the ids has a record with an abstract")
    published = S.publish(new.join(asked.distinct(), ["collection_id", "id"], "left_semi"), f"{store.folder}/documents")
    return report.asDict() | {"added": store.spark.read.parquet(published).count()}


MOST_FILES, MOST_BYTES, MOST_TOGETHER = 10, 20 * 1024 * 1024, 40 * 1024 * 1024


def uploaded(files: DataFrame, known_names: DataFrame | None = None, single: bool = False) -> DataFrame:
    """filename, name, error of an upload's files (filename, content): each gets a name made of its content, or an error.

    A ValueError for no files, more than ten (or one, if ``single``) or 40 MB together.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    n, together = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if not 1 <= n <= (1 if single else MOST_FILES):
        raise ValueError("one file" if single else f"1 to {MOST_FILES} files")
    if together > MOST_TOGETHER:
        raise ValueError("the files are larger than 40 MB together")
    base = F.element_at(F.split(F.replace("filename", F.lit("\\"), F.lit("/")), "/"), -1)
    suffix = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    allowed = (".xml", ".nxml") if single else (".xml", ".nxml", ".json")
    named = files.select(base.alias("filename"), F.concat(F.lit("upload_"), F.sha2("content", 256), suffix).alias("name"), suffix.alias("_s"), size.alias("_n"))
    if known_names is not None:
        named = named.join(known_names.select("name").distinct().withColumn("_k", F.lit(1)), "name", "left")
    else:
        named = named.withColumn("_k", F.lit(None).cast("int"))
    error = F.when(~F.col("_s").isin(*allowed), "this kind of file isn't read").when((F.col("_n") == 0) | (F.col("_n") > MOST_BYTES), "the file is empty or larger than 20 MB").when(F.col("_k") == 1, "there is a file of this content")
    return named.select("filename", F.when(error.isNull(), F.col("name")).alias("name"), error.alias("error"))
