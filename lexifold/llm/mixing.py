"""Mixing sources to target shares of tokens.

Each document has a place in its source, a 63-bit hash of its id.  Taking the
documents below a threshold takes a stable pseudo-random part of the source.  The
threshold for a number of tokens is found from histograms: tokens by source and
by the leading bits of the place give the bucket in which the budget ends, a
second histogram of only that bucket gives its part, and only that part's
documents are added up one by one.  No source is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.bpe import NAME, TOKENIZERS, token_counts
from lexifold.runtime import materialise

BITS = 10  # of the place in each histogram: 1,024 buckets
PLACE_BITS = 63


def tidy(source: str) -> Column:
    """A source's name trimmed and lower-cased."""
    return F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))


def sized_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """doc_id, source (tidied), n_tokens and place of every document with a source and a token."""
    counted = token_counts(documents, ["doc_id", "source"], "text", folder, name)
    return (
        counted.select("doc_id", tidy("source").alias("source"), "n_tokens")
        .filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
        .withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    )


def histogram(sized: DataFrame) -> DataFrame:
    """Tokens by source and first bucket of the place."""
    return sized.groupBy("source", F.shiftright("place", PLACE_BITS - BITS).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))


def budgets(buckets: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per plan and source: size, target_tokens, and whether the capped source falls short.

    Rows of a plan that name one source twice once tidied count as one, with the sum
    of the shares and the largest cap.  Null shares and caps count as 0.  A source
    without documents has size 0.
    """
    wanted = (
        targets.select("plan_id", tidy("source").alias("source"), "target_share", "max_repeats")
        .filter(F.col("source").isNotNull())
        .groupBy("plan_id", "source")
        .agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    )
    sizes = buckets.groupBy("source").agg(F.sum("tokens").alias("size"))
    joined = wanted.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    plan = Window.partitionBy("plan_id")
    return joined.withColumn("target_tokens", F.col("target_share") * F.sum("size").over(plan)).withColumn(
        "short", F.col("size") * F.col("max_repeats") < F.col("target_tokens")
    )


def mixture(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their copies, and the shares reached.

    First: plan_id, source, doc_id, n_tokens, copies (at least 1).  Second: plan_id,
    source, target_share, max_repeats, size, target_tokens, taken_tokens,
    reached_share (of all taken), budget_share (of the plan's total, which is what
    the targets are shares of; the two differ once a source falls short).  A source that is too small even repeated ``max_repeats`` times is
    taken so often; any other is taken whole as often as its target allows and once
    more below the threshold that fills up the rest without passing it.

    Documents with null, empty or blank text have no size and are never chosen, nor
    are those of null or unnamed sources.  Rows with one doc_id share a place and are
    taken together.  Extra columns are ignored; without documents, or without
    targets, nothing is chosen.
    """
    sized = materialise(sized_documents(documents, folder, name), "sized")
    planned = materialise(budgets(histogram(sized), targets), "budgets")
    whole = F.when(F.col("short"), F.col("max_repeats")).otherwise(F.floor(F.col("target_tokens") / F.col("size"))).cast("bigint")
    planned = planned.filter("size > 0").withColumn("whole", whole)
    planned = planned.withColumn("rest", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("target_tokens") - F.col("whole") * F.col("size")))
    open_ = planned.select("plan_id", "source", "rest", F.lit(0).cast("bigint").alias("low"))
    shift = PLACE_BITS
    for _ in range(2):  # the bucket where the budget ends, then its part
        shift -= BITS
        part = F.shiftright("place", shift)
        wanted = open_.withColumn("above", F.shiftright("low", shift + BITS)).alias("w")
        inside = sized.withColumn("above", F.shiftright("place", shift + BITS)).groupBy("source", "above", part.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        order = Window.partitionBy("plan_id", "source").orderBy("bucket")
        steps = (
            wanted.join(inside, ["source", "above"])
            .withColumn("upto", F.sum("tokens").over(order))
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("plan_id", "source")
            .agg(F.min_by(F.struct(F.col("bucket"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest")), "bucket").alias("at"))
        )
        open_ = materialise(steps.select("plan_id", "source", F.col("at.rest").alias("rest"), F.shiftleft(F.col("at.bucket"), shift).alias("low")), "thresholds")
    order = Window.partitionBy("plan_id", "source").orderBy("place")
    last = (
        open_.withColumn("part", F.shiftright("low", shift))
        .join(sized.withColumn("part", F.shiftright("place", shift)), ["source", "part"])
        .withColumn("upto", F.sum("n_tokens").over(order))
        .filter(F.col("upto") > F.col("rest"))
        .groupBy("plan_id", "source")
        .agg(F.min("place").alias("threshold"))
    )
    thresholds = materialise(planned.join(last, ["plan_id", "source"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("bigint"))), "chosen")
    copies = F.col("whole") + F.when(F.col("place") < F.col("threshold"), 1).otherwise(0)
    chosen = sized.join(thresholds.select("plan_id", "source", "whole", "threshold"), "source").withColumn("copies", copies).filter("copies > 0")
    chosen = chosen.select("plan_id", "source", "doc_id", "n_tokens", "copies")
    taken = chosen.groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"))
    plan = Window.partitionBy("plan_id")
    shares = (
        budgets(histogram(sized), targets)
        .join(taken, ["plan_id", "source"], "left")
        .withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0).cast("bigint")))
        .withColumn("reached_share", F.round(F.col("taken_tokens") / F.greatest(F.sum("taken_tokens").over(plan), F.lit(1)), 6))
        .withColumn("budget_share", F.round(F.col("taken_tokens") / F.greatest(F.sum("size").over(plan), F.lit(1)), 6))
        .drop("short")
    )
    return chosen, shares


def short_sources(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """plan_id and source of every plan's source that can't reach its target within its cap."""
    return budgets(histogram(sized_documents(documents, folder, name)), targets).filter("short").select("plan_id", "source")
