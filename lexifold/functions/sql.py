"""Functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexifold.functions.casing import casefold
from lexifold.functions.porter import _stem_arrays, porter_stem


def register(spark: SparkSession) -> None:
    """``porter_stem(word)`` and ``porter_stems(words)`` for folded words, ``casefold(word)`` with the full table."""
    spark.udf.register("porter_stem", porter_stem)
    spark.udf.register("porter_stems", _stem_arrays)
    spark.udf.register("casefold", casefold)
