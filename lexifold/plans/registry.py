"""All registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexifold.operators import search
from lexifold.plans import analysis, files, records, retrieval

QUERIES = {**records.QUERIES, **retrieval.QUERIES, **analysis.QUERIES, **files.QUERIES}
ORACLES = {**records.ORACLES, **retrieval.ORACLES, **analysis.ORACLES, **files.ORACLES}


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: a ranked search."""
    return search.search(retrieval.index(spark, folder), retrieval.OR, "OR")
