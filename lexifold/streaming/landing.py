"""Article files that keep arriving in a folder, appended to a topic's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexifold.sinks.state import append
from lexifold.sources import articles


def held_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """id of the tables that exist among ``paths``."""
    ids = spark.createDataFrame([], "id string")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            ids = ids.unionByName(spark.read.parquet(path).select("id"))
    return ids.distinct()


def follow(spark: SparkSession, folder: str, documents: str, deleted: str, errors: str, state: str, once: bool = True) -> StreamingQuery:
    """Append each new file's documents that are neither held nor deleted, and its errors, to their tables.

    A micro-batch that is run again finds its documents already held, so none is
    appended twice.
    """

    def batch(held: DataFrame, number: int) -> None:
        rows = articles.read(held).persist()
        found, failed = articles.loaded(rows)
        new = found.join(held_ids(spark, documents, deleted), "id", "left_anti")
        append(new.withColumn("batch", F.lit(number)), documents)
        append(failed.withColumn("batch", F.lit(number)), errors)
        rows.unpersist()

    writer = articles.files(spark, folder, streaming=True).writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
