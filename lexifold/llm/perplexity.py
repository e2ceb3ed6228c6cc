"""Perplexity of documents under a modified Kneser-Ney model of their language, with bands that reject.

A text counts as its lower-cased letters, with one blank for whatever lies between
them, so that scripts without blanks between words need no cutting.  The n-grams of
``order`` letters are counted by Spark, by language and over all documents; those of
lower orders are their continuation counts, the numbers of different letters before
them.  Discounts come from the numbers of n-grams counted once to four times, and what
they take off is a context's weight of the next lower order.  The model is kept in
sorted hash arrays, broadcast or, where they are large, as mapped files: an n-gram's
discounted share of its context, and a context's weight.  A document whose perplexity lies outside its language's band, so many
deviations below or above the median, is rejected as too uniform or too strange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexifold.llm import tables
from lexifold.llm.repetition import _is_letter
from lexifold.runtime import materialise

START, BLANK = 1, 32
_B = np.uint64(0x9E3779B97F4A7C15)


def language(c: Column | str) -> Column:
    """The base of a language tag in lower case; ``und`` for a null, blank or odd one."""
    base = F.regexp_extract(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"^([a-z]{2,3})(?:$|[-_])", 1)
    return F.when(F.coalesce(base, F.lit("")) == "", "und").otherwise(base)


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased letters, one blank between those that aren't neighbours."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _is_letter()[points]
    at = np.flatnonzero(kept)
    if not len(at):
        return np.empty(0, np.int64)
    gap = np.diff(at) > 1
    out = np.full(len(at) + int(gap.sum()), BLANK, np.int64)
    out[np.arange(len(at)) + np.concatenate([[0], np.cumsum(gap)])] = points[at]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _seed(tongue: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(tongue))


def grams(held: list[tuple[str, np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (language, symbols) texts: all symbols behind their texts' starts, and of each symbol its place there, its text's place, the hash of the ``order`` symbols up to it."""
    pads = np.full(order - 1, START, np.int64)
    joined = np.concatenate([x for _, s in held for x in (pads, s)]) if held else np.empty(0, np.int64)
    sizes = np.array([len(s) + order - 1 for _, s in held], np.int64)
    owner = np.repeat(np.arange(len(held)), sizes)
    at = np.flatnonzero(np.arange(len(joined)) - (np.cumsum(sizes) - sizes)[owner] >= order - 1)
    owner = owner[at]
    mixed = _mixed(joined.astype(np.uint64))
    whole = np.array([_seed(tongue) for tongue, _ in held], np.uint64)[owner] if len(at) else np.empty(0, np.uint64)
    for j in range(order - 1, -1, -1):
        whole = whole * _B + mixed[at - j]
    return joined, at, owner, _mixed(whole ^ np.uint64(order)).view(np.int64)


def windows(joined: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    return joined[at[:, None] + np.arange(1 - order, 1)] if len(at) else np.empty((0, order), np.int64)


def hashes(window: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """Hashes of a window's last 0 to all symbols."""
    out = [_mixed(seeds).view(np.int64)]
    for k in range(1, window.shape[1] + 1):
        h = seeds.copy()
        for j in range(k, 0, -1):
            h = h * _B + _mixed(window[:, -j].astype(np.uint64))
        out.append(_mixed(h ^ np.uint64(k)).view(np.int64))
    return out


def _slices(batches: Iterator[pa.RecordBatch], key: str, text: str, at_once: int) -> Iterator[tuple[list, list[tuple[str, np.ndarray]]]]:
    for batch in batches:
        keys, held, size = [], [], 0
        for identity, tongue, words in zip(*(batch.column(c).to_pylist() for c in (key, "_lang", text))):
            keys.append(identity)
            held.append((tongue, symbols(words)))
            size += len(held[-1][1])
            if size >= at_once:
                yield keys, held
                keys, held, size = [], [], 0
        if keys:
            yield keys, held


def counted(key: str, text: str, order: int, at_once: int):
    """Map task: texts to their n-grams' counts, added up as far as memory for ``at_once`` letters goes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _slices(batches, key, text, at_once):
            joined, at, owner, whole = grams(held, order)
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            tongues = [held[i][0] for i in owner[first]]
            window = windows(joined, at[first], order).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, window.size + 1, order, dtype=np.int32)), pa.array(window.ravel()))
            yield pa.record_batch([pa.array(tongues, pa.string()), listed, pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return task


@dataclass
class Model:
    """Sorted hash arrays: n-grams of all orders with their discounted shares, contexts of all orders with their weights."""

    order: int
    letters: dict[str, int]  # different letters by language
    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), otherwise)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], otherwise)

    def probabilities(self, window: np.ndarray, tongues: list[str]) -> np.ndarray:
        """Of each window's last symbol behind the others."""
        known = {t: _seed(t) for t in set(tongues)}
        seeds = np.array([known[t] for t in tongues], np.uint64)
        ends, befores = hashes(window, seeds), hashes(window[:, :-1], seeds)
        p = 1.0 / (np.array([self.letters.get(t, 0) for t in tongues]) + 1.0)  # one more for any letter not seen
        for k in range(1, self.order + 1):
            p = self._found(self.grams, self.shares, ends[k], 0.0) + self._found(self.contexts, self.weights, befores[k - 1], 1.0) * p
        return p


def _hashed(order: int):
    """UDF: hash of (language, its last so many symbols)."""

    @F.pandas_udf("bigint")
    def hashed(lang, gram):
        import pandas as pd

        window = np.array(gram.to_list(), np.int64).reshape(len(gram), order)
        known = {t: _seed(t) for t in lang.unique()}
        seeds = np.array([known[t] for t in lang], np.uint64)
        return pd.Series(hashes(window, seeds)[order])

    return hashed


def fit(texts: DataFrame, key: str, text: str, order: int = 4, least: int = 2, most: int | None = None, at_once: int = 1 << 20, in_memory: int = 4_000_000) -> Model:
    """The model of rows with ``_lang``; all n-grams are counted.

    All n-grams and contexts counted ``least`` times are kept: what is seen once is seen
    in the very text that is to be judged and would speak for it.  Up to ``in_memory`` of
    either (12 bytes each) are broadcast; more are in mapped files, with the same
    results.  Only a caller who gives ``most`` gets a smaller model: where more of either
    would be, ``least`` is doubled.
    """
    rows = texts.select(key, "_lang", text).mapInArrow(counted(key, text, order, at_once), "lang string, gram array<int>, n bigint")
    level = materialise(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"grams-{order}")
    n = F.col("n")
    parts, weights = [], []
    for k in range(order, 0, -1):
        sums = level.groupBy("lang").agg(*(F.count_if(n == i).cast("double").alias(f"n{i}") for i in range(1, 5)))  # a row a language
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        took = [F.least(F.lit(float(i)), F.greatest(F.lit(0.0), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
        discounted = level.join(F.broadcast(sums.select("lang", *took)), "lang")
        d = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        before = F.slice("gram", 1, k - 1)
        discounted = discounted.select("lang", "gram", "n", before.alias("before"), d.alias("d"))
        # A context's sums; one letter can stand behind it in any part of all texts, but only once in this table.
        held = discounted.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        share = discounted.join(held, ["lang", "before"]).select("lang", "gram", "n", ((n - F.col("d")) / F.col("total")).cast("float").alias("share"))
        parts.append(share.select(_hashed(k)("lang", "gram").alias("hash"), "share", "n"))
        weights.append(held.select(_hashed(k - 1)("lang", "before").alias("hash"), (F.col("taken") / F.col("total")).cast("float").alias("weight"), F.col("total").alias("n")))
        if k > 1:
            level = materialise(level.groupBy("lang", F.slice("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k - 1}")
    letters = {r[0]: r[1] for r in level.groupBy("lang").count().collect()}
    arrays = []
    for found, value in ((parts, "share"), (weights, "weight")):
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        whole = materialise(whole, value)
        enough = least
        while most is not None and whole.filter(n >= enough).count() > most and enough < 1 << 40:
            enough *= 2
        arrays += tables.looked_up(whole.filter(n >= enough), [value], np.float32, in_memory)
    return Model(order, letters, *arrays)


def scored(key: str, text: str, sent, at_once: int):
    """Map task: texts to their number of letters and mean log probability; every different window of a slice is looked up once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        kind = None
        for keys, held in _slices(batches, key, text, at_once):
            joined, at, owner, whole = grams(held, model.order)
            _, first, back = np.unique(whole, return_index=True, return_inverse=True)
            p = model.probabilities(windows(joined, at[first], model.order), [held[i][0] for i in owner[first]]) if len(first) else np.empty(0)
            logs = np.bincount(owner, weights=np.log(np.maximum(p, 1e-12))[back], minlength=len(held)) if len(first) else np.zeros(len(held))
            n = np.array([len(s) for _, s in held], np.int64)
            entropy = pa.array(np.where(n > 0, -logs / np.maximum(n, 1), 0.0), mask=n == 0)
            kind = kind or pa.array(keys).type
            yield pa.record_batch([pa.array(keys, kind), pa.array([t for t, _ in held], pa.string()), pa.array(n), entropy], names=[key, "lang", "n_symbols", "entropy"])

    return task


def perplexity(
    texts: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = 4, low: float = 4.0, high: float = 4.0, least: int = 2, most: int | None = None,
    at_once: int = 1 << 20, in_memory: int = 4_000_000,
) -> DataFrame:
    """One row per row: key, lang (its base, ``und`` without), n_symbols, perplexity, band.

    ``band`` is low or high where the logarithm of the perplexity lies more than ``low``
    or ``high`` deviations (1.4826 times the median of the distances) below or above
    the language's median, else inside; a language whose texts are all alike rejects
    none.  Null, empty and blank texts and those without letters have a null perplexity
    and the band none.  Repeated rows come out each and count each; extra columns are
    ignored; an empty table gives an empty result.
    """
    kind = texts.schema[key].dataType.simpleString()
    held = texts.select(key, text, language(lang).alias("_lang"))
    sent = tables.send(texts.sparkSession, fit(held, key, text, order, least, most, at_once, in_memory))
    rows = held.select(key, "_lang", text).mapInArrow(scored(key, text, sent, at_once), f"`{key}` {kind}, lang string, n_symbols bigint, entropy double")
    rows = materialise(rows, "entropy")
    usual = rows.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 10_000).alias("usual"))
    apart = rows.join(F.broadcast(usual), "lang").groupBy("lang").agg(F.first("usual").alias("usual"), F.percentile_approx(F.abs(F.col("entropy") - F.col("usual")), 0.5, 10_000).alias("apart"))
    off = (F.col("entropy") - F.col("usual")) / (1.4826 * F.col("apart"))
    band = F.when(F.col("entropy").isNull(), "none").when(F.col("apart") <= 1e-9, "inside").when(off < -low, "low").when(off > high, "high").otherwise("inside")
    return rows.join(F.broadcast(apart), "lang", "left").select(key, "lang", "n_symbols", F.round(F.exp("entropy"), 6).alias("perplexity"), band.alias("band"))
