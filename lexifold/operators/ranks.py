"""Ranks inside groups that may hold any part of all rows.

A window function sorts each group in one task.  Here rows are range-partitioned
by group and order and sorted inside their partitions, so a large group lies across
many tasks; each row's rank is its place in its partition behind the rows of its
group in earlier partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.runtime import materialise


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """With ``name``: 1..n in each group of ``by``, in ``order``, which must decide between any two rows of a group.

    One exchange and one write: sorted rows are numbered as they leave their
    partition, and what the group has in earlier partitions is one row for each group
    and task.  The written table also fixes the numbers if a task is lost.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order)
    placed = materialise(placed.withColumn("_seq", F.monotonically_increasing_id()), "ranges")  # partition << 33 | row
    part = F.shiftright("_seq", 33).alias("_part")
    sizes = placed.groupBy(*by, part).agg(F.count("*").alias("_size"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"_{k}") for k in by], "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by), F.shiftright("_seq", 33) == F.col("_part"))
    return placed.join(before, same).select(*rows.columns, (F.col("_seq") + F.col("_shift")).cast("bigint").alias(name))


def first_of(rows: DataFrame, by: list[str], order: list[Column | str], most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each group with their rank: a report's top rows, cut down before any exchange."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most).withColumn(name, F.col(name).cast("bigint"))
