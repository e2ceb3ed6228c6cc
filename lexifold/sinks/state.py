"""State tables: small Parquet tables replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def replace(table: DataFrame, path: str) -> None:
    """Write beside the old table and put the new one in its place by renaming.

    The rows may come from the old table: it is read in full before it moves.  Between
    the two renames a reader finds no table; ``held`` then waits for it.  On a store
    without renames the copy takes as long as the table is large.
    """
    jvm = table.sparkSession.sparkContext._jvm
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}", path))
    table.write.parquet(new.toString())
    files = target.getFileSystem(conf)
    if files.exists(target):
        files.rename(target, old)
    if not files.rename(new, target):
        files.rename(old, target)
        raise OSError(f"{path} couldn't be replaced")
    files.delete(old, True)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a table that only grows, as a log or list of deletions does."""
    rows.write.mode("append").parquet(path)


def held(spark, path: str, seconds: float = 10.0) -> DataFrame:
    """The table at ``path``, waited for while it is being replaced."""
    import time

    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = time.monotonic() + seconds
    while not files.exists(target) and time.monotonic() < end:
        time.sleep(0.1)
    return spark.read.parquet(path)


def publish(rows: DataFrame, path: str) -> str:
    """Rows as a new batch of a table, seen whole or not at all; the batch's folder, for ``withdraw``."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    number = uuid.uuid4().hex
    staged, batch, table = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/_staged-{number}", f"{path}/batch={number}", path))
    rows.write.parquet(staged.toString())  # a name that readers pass over
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(staged, batch):
        files.delete(staged, True)
        raise OSError(f"{batch} couldn't be published")
    return batch.toString()


def withdraw(spark, batch: str) -> None:
    """Take back a published batch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(batch)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
