"""Vocabulary statistics by topic: frequencies, ranks, rank-frequency regression, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.functions.porter import occurrences, stems
from lexifold.operators import ranks
from lexifold.runtime import materialise

CONDITIONS = ("A", "B", "C", "D")


def document_tf(documents: DataFrame, condition: str) -> DataFrame:
    """collection_id, id, term, tf over the abstracts."""
    return documents.select("collection_id", "id", F.explode(occurrences(X.conditioned("abstract", condition))).alias("term", "tf"))


def frequencies(documents: DataFrame, condition: str) -> DataFrame:
    """collection_id, term, cf, df."""
    return document_tf(documents, condition).groupBy("collection_id", "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def sizes(documents: DataFrame) -> DataFrame:
    """collection_id, documents: all of a topic's documents, those without abstract among them."""
    return documents.groupBy("collection_id").agg(F.count("*").alias("documents"))


def idf(documents: Column, df: Column) -> Column:
    return F.when((documents > 0) & (df > 0), F.log(documents / df)).otherwise(0.0)


def ranked(terms: DataFrame) -> DataFrame:
    """With ``rank``: 1..n in each topic by falling cf, ties to the smaller term."""
    return ranks.ranked(terms, ["collection_id"], [F.col("cf").desc(), F.col("term")])


def fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Least squares of log10(cf) on log10(rank) in each group; all 0 for fewer than two points."""
    x, y = F.log10("rank"), F.log10("cf")
    sums = points.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )
    some = (F.col("n") >= 2) & (F.col("sxx") > 0)
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    # Frequencies that are all one leave only rounding noise in syy.
    varied = F.col("syy") > 1e-12
    return sums.select(
        *by,
        F.round(F.when(some, F.col("slope")).otherwise(0.0), 6).alias("slope"),
        F.round(F.when(some, F.col("intercept")).otherwise(0.0), 6).alias("intercept"),
        F.round(F.when(some, -F.col("slope")).otherwise(0.0), 6).alias("exponent"),
        F.round(F.when(some & varied, 1 - left / F.col("syy")).otherwise(0.0), 6).alias("r_squared"),
        F.round(F.when(some, F.sqrt(left / F.col("n"))).otherwise(0.0), 6).alias("rmse"),
    )


def summary(documents: DataFrame, condition: str, terms: DataFrame | None = None) -> DataFrame:
    """collection_id, documents, total_tokens, unique_terms, average_tokens; ``terms`` are the frequencies, if at hand."""
    held = (terms or frequencies(documents, condition)).groupBy("collection_id").agg(F.sum("cf").alias("total_tokens"), F.count("*").alias("unique_terms"))
    joined = sizes(documents).join(held, "collection_id", "left")
    total = F.coalesce("total_tokens", F.lit(0).cast("bigint"))
    return joined.select(
        "collection_id", "documents", total.alias("total_tokens"), F.coalesce("unique_terms", F.lit(0).cast("bigint")).alias("unique_terms"),
        F.round(total / F.col("documents"), 6).alias("average_tokens"),
    )


def regression(documents: DataFrame, condition: str, terms: DataFrame | None = None) -> DataFrame:
    return fit(ranked(terms or frequencies(documents, condition)), ["collection_id"])


def measured(documents: DataFrame, condition: str) -> DataFrame:
    """Summary and regression; the texts are read once for both."""
    terms = materialise(frequencies(documents, condition), "frequencies")
    return summary(documents, condition, terms).join(regression(documents, condition, terms), "collection_id", "left")


def top_terms(terms: DataFrame, most: int) -> DataFrame:
    """The ``most`` frequent terms of each topic with their ranks."""
    return ranks.first_of(terms, ["collection_id"], [F.col("cf").desc(), F.col("term")], most)


def regions(documents: DataFrame, condition: str) -> DataFrame:
    """Regression of the high, middle and low thirds of the ranks."""
    terms = ranked(frequencies(documents, condition))
    terms = terms.join(terms.groupBy("collection_id").agg(F.count("*").alias("n")), "collection_id")
    first = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    second = F.greatest(F.lit(2), F.floor(2 * F.col("n") / 3))
    region = F.when(F.col("rank") <= first, "high").when(F.col("rank") <= second, "middle").otherwise("low")
    return fit(terms.withColumn("region", region), ["collection_id", "region"])


def all_conditions(documents: DataFrame) -> DataFrame:
    """Summary and regression under each of the four conditions.

    One reading of the texts, one aggregation and one ranking serve all four: B's tokens
    are cut once and C and D are drawn from them, and the condition is a key beside the topic.
    """
    found = documents.select("collection_id", "id", X.basic_tokens("abstract").alias("A"), X.tokens("abstract").alias("B"))
    found = found.withColumn("C", X.without_stop_words(F.col("B"))).withColumn("D", stems(F.col("C")))

    def counted(c: str) -> Column:
        return F.transform(F.map_entries(occurrences(F.col(c))), lambda e: F.struct(F.lit(c).alias("condition"), e.key.alias("term"), e.value.alias("tf")))

    each = [counted(c) for c in CONDITIONS]
    terms = found.select("collection_id", F.explode(F.concat(*each)).alias("e")).select("collection_id", "e.*")
    by = ["collection_id", "condition"]
    terms = materialise(terms.groupBy(*by, "term").agg(F.sum("tf").alias("cf")), "frequencies")
    held = terms.groupBy(*by).agg(F.sum("cf").alias("total_tokens"), F.count("*").alias("unique_terms"))
    fitted = fit(ranks.ranked(terms, by, [F.col("cf").desc(), F.col("term")]), by)
    every = sizes(documents).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    joined = every.join(held, by, "left").join(fitted, by, "left").fillna(0).fillna(0.0)
    measures = ("slope", "intercept", "exponent", "r_squared", "rmse")
    return joined.select(
        "collection_id", "documents", "total_tokens", "unique_terms", F.round(F.col("total_tokens") / F.col("documents"), 6).alias("average_tokens"), *measures, "condition"
    )


def comparison(documents: DataFrame, left: str, right: str, condition: str) -> DataFrame:
    """measure, left, right for two different topics, and whether their sizes differ."""
    if left == right:
        raise ValueError("a comparison needs two different topics")
    both = documents.filter(F.col("collection_id").isin(left, right))
    sides = measured(both, condition)
    names = ("documents", "total_tokens", "unique_terms", "average_tokens", "slope", "exponent", "r_squared")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value")) for n in names]))
    long = sides.select("collection_id", pairs.alias("m")).select("collection_id", "m.measure", "m.value")
    side = lambda c, name: F.coalesce(F.max(F.when(F.col("collection_id") == c, F.col("value"))), F.lit(0.0)).alias(name)
    wide = long.groupBy("measure").agg(side(left, "left"), side(right, "right"))
    return wide.withColumn("differs", F.col("left") != F.col("right"))


def chart_points(terms: DataFrame, most: int = 550) -> DataFrame:
    """collection_id, rank, term, cf at no more than ``most`` evenly spaced ranks of each topic."""
    n = terms.groupBy("collection_id").agg(F.count("*").alias("n")).withColumn("k", F.least(F.col("n"), F.lit(most)))
    step = F.when(F.col("k") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda i: F.bround(i * (F.col("n") - 1) / (F.col("k") - 1)).cast("bigint"))
    )
    ranks = n.select("collection_id", F.explode(F.array_distinct(step)).alias("at")).select("collection_id", (F.col("at") + 1).alias("rank"))
    return terms.join(ranks, ["collection_id", "rank"]).select("collection_id", "rank", "term", "cf")


def query_term(value: str, condition: str) -> str:
    """The one term of an input under a condition; a ValueError for none or several."""
    from lexifold.functions.porter import stem
    from lexifold.operators.search import query_tokens

    folded = value[:100].strip().lower().replace("ß", "ss")
    found = [p for p in folded.split() if any(c.isalnum() for c in p)] if condition == "A" else query_tokens(folded)
    if condition in ("C", "D"):
        found = [t for t in found if t not in X.STOP_WORDS]
    if condition == "D":
        found = [stem(t) for t in found]
    if len(found) != 1:
        raise ValueError("exactly one term is needed")
    return found[0]


def distribution(documents: DataFrame, numbers: DataFrame, value: str, condition: str) -> DataFrame:
    """Documents that hold a term, most occurrences first in each topic: number, id, title, term, tf, width, rank."""
    term = query_term(value, condition)
    tf = F.size(F.filter(X.conditioned("abstract", condition), lambda t: t == F.lit(term))).cast("bigint")
    held = documents.withColumn("tf", tf).filter("tf > 0").join(numbers, ["collection_id", "id"])
    held = ranks.ranked(held.select("collection_id", "number", "id", "title", F.lit(term).alias("term"), "tf"), ["collection_id"], [F.col("tf").desc(), F.col("number")])
    most = held.groupBy("collection_id").agg(F.max("tf").alias("most"))
    return held.join(most, "collection_id").select(
        "collection_id", "number", "id", "title", "term", "tf", F.round(100 * F.col("tf") / F.col("most"), 2).alias("width"), "rank"
    )
