"""Word embeddings by topic: vocabulary, examples, training, neighbours, projection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.runtime import materialise

MODELS = ("skipgram", "cbow")


def validate(model: str = "skipgram", dimension: int = 24, window: int = 2, epochs: int = 2) -> None:
    if model not in MODELS:
        raise ValueError("unknown model")
    for value, low, high, name in ((dimension, 8, 64, "dimension"), (window, 1, 5, "window"), (epochs, 1, 5, "epochs")):
        if not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}")


def words(documents: DataFrame) -> DataFrame:
    """collection_id, id, article_no, words: an abstract's words of letters that are no stop words."""
    found = F.filter(X.without_stop_words(X.tokens("abstract")), lambda w: w.rlike(r"^\p{L}+$"))
    return documents.select("collection_id", "id", "article_no", found.alias("words"))


def vocabulary(documents: DataFrame, most: int = 800, least: int = 2) -> DataFrame:
    """collection_id, word, n, place: the ``most`` frequent words with at least ``least`` occurrences; ties to the word seen first."""
    each = words(documents).select("collection_id", "article_no", F.posexplode("words").alias("pos", "word"))
    counted = each.groupBy("collection_id", "word").agg(F.count("*").alias("n"), F.min(F.struct("article_no", "pos")).alias("seen"))
    order = Window.partitionBy("collection_id").orderBy(F.col("n").desc(), "seen")
    placed = counted.withColumn("place", F.row_number().over(order).cast("bigint"))
    return placed.filter((F.col("place") <= most) & (F.col("n") >= least)).select("collection_id", "word", "n", "place")


def sequences(documents: DataFrame, vocabulary: DataFrame, few: int = 1_000_000) -> DataFrame:
    """collection_id, id, article_no, words: each abstract's words that are in the vocabulary, in order.

    Up to ``few`` vocabulary words (800 a topic) are sent to the abstracts as hash sets;
    of more topics, each abstract gets its own topic's by a join.
    """
    listed = vocabulary.groupBy("collection_id").agg(F.collect_set("word").alias("known"))
    found = words(documents)
    sets = listed.agg(F.coalesce(F.sum(F.size("known")), F.lit(0))).first()[0]
    if sets > few:
        kept = F.filter("words", lambda w: F.array_contains("known", w))
        return found.join(listed, "collection_id").select("collection_id", "id", "article_no", kept.alias("words"))
    known = documents.sparkSession.sparkContext.broadcast({r[0]: frozenset(r[1]) for r in listed.collect()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, lists = batch.column("collection_id").to_pylist(), batch.column("words").to_pylist()
            kept = [[w for w in ws if w in known.value[t]] if t in known.value else None for t, ws in zip(topics, lists)]
            held = [k is not None for k in kept]
            columns = [batch.column(c) for c in ("collection_id", "id", "article_no")] + [pa.array(kept, pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["collection_id", "id", "article_no", "words"]).filter(pa.array(held))

    return found.mapInArrow(task, "collection_id string, id string, article_no bigint, words array<string>")


def contexts(sequences: DataFrame, window: int = 2) -> DataFrame:
    """collection_id, id, article_no, pos, center, context: the words up to ``window`` places around each word."""

    def around(word: Column, at: Column) -> Column:
        before = F.slice("words", F.greatest(F.lit(1), at + 1 - window), F.least(F.lit(window), at))
        return F.struct(word.alias("center"), F.concat(before, F.slice("words", at + 2, F.lit(window))).alias("context"))

    # Contexts are cut before the words are unfolded, so no row carries its whole abstract.
    each = sequences.select("collection_id", "id", "article_no", F.posexplode(F.transform("words", around)).alias("pos", "_c"))
    return each.select("collection_id", "id", "article_no", F.col("pos").cast("bigint").alias("pos"), "_c.center", "_c.context")


def cbow_examples(sequences: DataFrame, window: int = 2) -> DataFrame:
    """One example per word with a context."""
    return contexts(sequences, window).filter(F.size("context") > 0)


def skipgram_pairs(sequences: DataFrame, window: int = 2) -> DataFrame:
    """One pair per word and context word, in order."""
    pairs = contexts(sequences, window).select("collection_id", "id", "article_no", "pos", "center", F.posexplode("context").alias("k", "target"))
    return pairs.withColumn("k", F.col("k").cast("bigint"))


def capped(examples: DataFrame, most: int = 60_000, steps: int = 1024) -> DataFrame:
    """The first ``most`` examples of each topic in document order.

    No topic is sorted: documents' counts are summed up in ``steps`` steps of arrival
    numbers, the running sums show the step in which the limit is reached, that step's
    documents show in which of them, and only that document's examples are ordered.
    """
    columns = [c for c in ("article_no", "pos", "k") if c in examples.columns]
    own = materialise(examples.groupBy("collection_id", "article_no").agg(F.count("*").alias("n")), "counts")
    range_ = own.groupBy("collection_id").agg(F.min("article_no").alias("low"), F.max("article_no").alias("high"))
    step = F.floor((F.col("article_no") - F.col("low")) * steps / (F.col("high") - F.col("low") + 1))
    stepped = own.join(range_, "collection_id").select("collection_id", "article_no", "n", step.alias("step"))
    so_far = lambda *order: F.sum("n").over(Window.partitionBy("collection_id").orderBy(*order))
    sums = stepped.groupBy("collection_id", "step").agg(F.sum("n").alias("n"))  # at most ``steps`` rows a topic
    last = sums.withColumn("sum", so_far("step")).filter(F.col("sum") - F.col("n") < most).groupBy("collection_id").agg(F.max_by(F.struct("step", (F.col("sum") - F.col("n")).alias("before")), "step").alias("l"))
    inside = stepped.join(last.select("collection_id", "l.step", "l.before"), ["collection_id", "step"])
    inside = inside.withColumn("left", most - F.col("before") - so_far("article_no") + F.col("n")).filter("left > 0")
    edge = inside.groupBy("collection_id").agg(F.max_by(F.struct(F.col("article_no").alias("edge"), "left"), "article_no").alias("e"))
    held = examples.join(edge.select("collection_id", "e.edge", "e.left"), "collection_id").filter(F.col("article_no") <= F.col("edge"))
    whole = held.filter(F.col("article_no") < F.col("edge")).select(*examples.columns)
    order = Window.partitionBy("collection_id", "article_no").orderBy(*columns)
    part = held.filter(F.col("article_no") == F.col("edge")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("left"))
    return whole.unionByName(part.select(*examples.columns))


def negative_cdf(vocabulary: DataFrame) -> DataFrame:
    """collection_id, word, place, cumulative: running sum of n^0.75 in vocabulary order."""
    order = Window.partitionBy("collection_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return vocabulary.select("collection_id", "word", "place", F.round(F.sum(F.pow(F.col("n"), F.lit(0.75))).over(order), 6).alias("cumulative"))


def _train(examples: list[tuple[list[int], int]], n: np.ndarray, dimension: int, epochs: int, negatives: int, seed: int) -> np.ndarray:
    """Negative-sampling updates, one example with its drawn words after the other; unit vectors."""
    draw = np.random.default_rng(seed)
    inner = draw.uniform(-0.5 / dimension, 0.5 / dimension, (len(n), dimension))
    outer = np.zeros((len(n), dimension))
    cumulative = np.cumsum(n.astype(float) ** 0.75)
    targets = np.array([t for _, t in examples])
    labels = np.zeros(negatives + 1)
    labels[0] = 1
    for epoch in range(epochs):
        rate = 0.035 * (1 - 0.35 * epoch / max(1, epochs - 1))
        order = draw.permutation(len(examples))
        drawn = np.searchsorted(cumulative, draw.random((len(examples), negatives)) * cumulative[-1])
        hit = targets[order][:, None]
        drawn = np.hstack([hit, np.where(drawn == hit, (drawn + 1) % len(n), drawn)])
        for words, k in zip(drawn, order):
            sources = examples[k][0]
            # Each drawn word is met with the sources as the words before it left them.
            for word, label in zip(words, labels):
                hidden = inner[sources[0]] if len(sources) == 1 else inner[sources].mean(axis=0)
                held = outer[word]
                gradient = rate * (label - 1 / (1 + np.exp(-min(8.0, max(-8.0, float(held @ hidden))))))
                step = gradient / len(sources) * held
                outer[word] = held + gradient * hidden
                for source in sources:
                    inner[source] += step
    size = np.linalg.norm(inner, axis=1, keepdims=True)
    return inner / np.where(size > 0, size, 1)


def train(
    documents: DataFrame, model: str = "skipgram", dimension: int = 24, window: int = 2, epochs: int = 2, most_words: int = 800,
    most_examples: int = 60_000, negatives: int = 3, tasks: int = 64,
) -> DataFrame:
    """collection_id, word, n, vector, examples: one model per topic, trained side by side.

    A model is a sequence of updates and takes one task; its input is bounded by the
    word and example limits.  Topics with fewer than two words have no model.
    Training costs far more than its input weighs, so topics are spread over
    ``tasks`` partitions that aren't merged by size.
    """
    validate(model, dimension, window, epochs)
    vocab = vocabulary(documents, most_words)
    held = sequences(documents, vocab)
    if model == "cbow":
        rows = capped(cbow_examples(held, window), most_examples).select("collection_id", "article_no", "pos", F.lit(0).cast("bigint").alias("k"), F.col("context").alias("sources"), F.col("center").alias("target"))
    else:
        rows = capped(skipgram_pairs(held, window), most_examples).select("collection_id", "article_no", "pos", "k", F.array("center").alias("sources"), "target")
    seed = 42 + 3 * dimension + 11 * window + 17 * epochs + (model == "cbow")

    def fit(key, examples: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values("place")
        if len(listed) < 2:
            return pd.DataFrame({"collection_id": [], "word": [], "n": [], "vector": [], "examples": []})
        index = {w: i for i, w in enumerate(listed["word"])}
        ordered = examples.sort_values(["article_no", "pos", "k"])
        pairs = [([index[s] for s in sources], index[t]) for sources, t in zip(ordered["sources"], ordered["target"])]
        vectors = _train(pairs, listed["n"].to_numpy(), dimension, epochs, negatives, seed)
        return pd.DataFrame({"collection_id": key[0], "word": listed["word"].to_numpy(), "n": listed["n"].to_numpy(), "vector": list(vectors), "examples": len(pairs)})

    # Both sides stem from the same documents; fresh names keep their columns apart.
    topics = vocab.select(F.col("collection_id").alias("topic"), F.col("word").alias("word"), F.col("n").alias("n"), F.col("place").alias("place"))
    return rows.repartition(tasks, "collection_id").groupBy("collection_id").cogroup(topics.repartition(tasks, "topic").groupBy("topic")).applyInPandas(
        fit, "collection_id string, word string, n bigint, vector array<double>, examples bigint"
    )


def nearest(vectors: DataFrame, queries: DataFrame, by: list[str], key: str, vector: str, most: int = 10, block: int = 4096) -> DataFrame:
    """The ``most`` nearest rows of each query by cosine, ties to the smaller key.

    ``queries`` holds the columns ``by``, ``key`` and ``vector`` of the rows asked for;
    every row is measured against every query of its group, the query itself left out.
    Queries go out in blocks of ``block`` unit vectors, whatever their number; a task
    multiplies its rows with a block and hands on each query's nearest.  Null and zero
    vectors, and those of another length than the block's, have no similarity.
    """
    spark = vectors.sparkSession
    asked = queries.select(*by, key, vector).filter(F.col(vector).isNotNull()).dropDuplicates([*by, key])
    kinds = {n: vectors.schema[n].dataType.simpleString() for n in (*by, key)}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in by), f"`query` {kinds[key]}", f"`{key}` {kinds[key]}", "similarity double"])
    found, held = [], []

    def against(rows: list) -> DataFrame:
        length = max(len(r[vector]) for r in rows)
        rows = [r for r in rows if len(r[vector]) == length]
        matrix = np.array([r[vector] for r in rows], np.float64).reshape(len(rows), length)
        matrix /= np.where((size := np.linalg.norm(matrix, axis=1, keepdims=True)) > 0, size, np.nan)
        sent = spark.sparkContext.broadcast((matrix, [r[key] for r in rows], [tuple(r[n] for n in by) for r in rows]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, names, groups = sent.value
            for whole in batches:
                for first in range(0, whole.num_rows, 2048):
                    batch = whole.slice(first, 2048)
                    lists = batch.column(vector).to_pylist()
                    fit = [i for i, v in enumerate(lists) if v is not None and len(v) == matrix.shape[1]]
                    if not fit:
                        continue
                    own = np.array([lists[i] for i in fit], np.float64)
                    own /= np.where((size := np.linalg.norm(own, axis=1, keepdims=True)) > 0, size, np.nan)
                    near = own @ matrix.T
                    keys = [batch.column(key)[i].as_py() for i in fit]
                    ours = list(zip(*(batch.column(n).take(pa.array(fit)).to_pylist() for n in by))) if by else [()] * len(fit)
                    out: list[list] = [[] for _ in (*by, "query", key, "similarity")]
                    for q, (name, group) in enumerate(zip(names, groups)):
                        column = np.where([g == group and k != name for g, k in zip(ours, keys)], near[:, q], np.nan)
                        there = np.flatnonzero(~np.isnan(column))
                        if len(there) > most:  # whatever ties with the last as rounded stays
                            there = there[column[there] >= np.partition(column[there], -most)[-most] - 2e-6]
                        for i in there:
                            for c, value in zip(out, (*group, name, keys[i], float(column[i]))):
                                c.append(value)
                    fields = [batch.schema.field(n).type for n in by] + [batch.schema.field(key).type] * 2 + [pa.float64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, fields)], names=[*by, "query", key, "similarity"])

        return vectors.select(*by, key, vector).mapInArrow(task, schema)

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            found.append(against(held))
            held = []
    if held or not found:
        found.append(against(held) if held else spark.createDataFrame([], schema))
    met = reduce(DataFrame.unionByName, found).withColumn("similarity", F.round("similarity", 6))
    order = Window.partitionBy(*by, "query").orderBy(F.col("similarity").desc(), key)
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(*by, "query", key, "similarity", F.col("rank").cast("bigint").alias("rank"))


def covariance(vectors: DataFrame, vector: str) -> DataFrame:
    """i, j, covariance: sample covariance of the vector's components, i <= j.

    A task hands on its vectors' number, sums and products of components as one row per
    pair of components, whatever the number of vectors; null vectors are left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0.0, 0.0
        for batch in batches:
            held = [v for v in batch.column(vector).to_pylist() if v is not None]
            if held:
                own = np.array(held, np.float64)
                n, sums, products = n + len(own), sums + own.sum(axis=0), products + own.T @ own
        if n:
            i, j = np.triu_indices(len(sums))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(np.full(len(i), float(n))), pa.array(sums[i]), pa.array(sums[j]), pa.array(products[i, j])], names=["i", "j", "n", "x", "y", "xy"])

    parts = vectors.select(vector).mapInArrow(task, "i bigint, j bigint, n double, x double, y double, xy double")
    n, x, y, xy = (F.sum(c) for c in ("n", "x", "y", "xy"))
    return parts.groupBy("i", "j").agg(F.round(F.when(n > 1, (xy - x * y / n) / (n - 1)), 9).alias("covariance"))


def selected(vectors: DataFrame, query: str | None = None, most: int = 90, near: int = 50) -> DataFrame:
    """The words shown together: the query, its nearest, then the most frequent; at most ``most`` per topic."""
    asked = vectors.filter(F.col("word") == query) if query is not None else vectors.limit(0)
    close = nearest(vectors, asked, ["collection_id"], "word", "vector", min(near, most - 1))
    place = F.when(F.col("word") == query, 0).when(F.col("rank").isNotNull(), F.col("rank")).otherwise(1 << 30) if query is not None else F.lit(1 << 30)
    joined = vectors.join(close.select("collection_id", "word", "rank", "similarity"), ["collection_id", "word"], "left").withColumn("place", place)
    order = Window.partitionBy("collection_id").orderBy("place", F.col("n").desc(), "word")
    return joined.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n", "rank", "place")


def projection(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, tuple[float, float]]:
    """key, x, y on the first two principal axes of centred vectors, and the axes' shares of the variance.

    Each axis points where its product with (1, 1/2, 1/3, ...) isn't negative.  Fewer
    than three vectors give no points and shares of 0.
    """
    held = vectors.select(key, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("_v"))
    if held.limit(3).count() < 3:
        return held.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0), (0.0, 0.0)
    mean = np.array(held.select(Summarizer.mean(F.col("_v"))).first()[0])
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(held)
    axes = model.pc.toArray()
    start = 1 / np.arange(1, len(mean) + 1)
    signs = np.where(start @ axes < 0, -1.0, 1.0)
    shift = mean @ axes
    point = vector_to_array("_p")
    shares = model.explainedVariance.toArray()
    x, y = ((point[k] - float(shift[k])) * float(signs[k]) for k in (0, 1))
    return model.transform(held).select(key, F.round(x, 6).alias("x"), F.round(y, 6).alias("y")), (float(shares[0]), float(shares[1]))


def train_skipgram(documents: DataFrame, **parameters) -> DataFrame:
    return train(documents, "skipgram", **parameters)


def train_cbow(documents: DataFrame, **parameters) -> DataFrame:
    return train(documents, "cbow", **parameters)


def radius(frequency: Column | str, is_query: Column) -> Column:
    """Of a word's point in the projection: 7 for the query, else by its frequency, at most 6."""
    n = F.col(frequency) if isinstance(frequency, str) else frequency
    return F.when(is_query, F.lit(7.0)).otherwise(F.least(F.lit(6.0), 3.3 + 0.35 * F.log1p(n.cast("double"))))


def hints(words: DataFrame, vectors: DataFrame, spelling: DataFrame) -> DataFrame:
    """collection_id, word, suggestion of the words (collection_id, word) without a vector: a near word of the spelling vocabulary that has one, or null."""
    from lexifold.operators.spelling import suggestions

    known = vectors.select("collection_id", "word").distinct()
    missing = words.select("collection_id", "word").distinct().join(known, ["collection_id", "word"], "left_anti")
    near = suggestions(missing, spelling.join(known, ["collection_id", "word"], "left_semi"))
    return near.select("collection_id", "word", F.when(F.col("suggestion") != F.col("word"), F.col("suggestion")).alias("suggestion"))
