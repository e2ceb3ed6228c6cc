"""How typical a term is of one record among all records.

Every term of a record has a two-by-two table against the remaining collection:
its count in the record, its count elsewhere, and the other terms' counts in both.
Two scores are drawn from these counts: Dunning's log-likelihood ratio (its sign
says whether the term is over- or under-represented) and count x ln(N / records).

The term statistics come from the burst-trie counter.  Scoring then needs each
record's terms beside them.  Sending all (record, term) pairs through a shuffle
would multiply the input, so it is avoided in two exact steps:

* Terms in at least ``share`` of the records are sent to every task.  There are at
  most (mean distinct terms of a record) / share of them, and the threshold is
  raised until no more than ``most_shared`` remain.
* A record's remaining terms could at best score as terms of two records (of one,
  if such terms count).  Only those whose best case reaches the record's third best
  shared term are shuffled to the statistics.

Where all terms are asked for, only the first step saves anything.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexifold.llm.burst import count_terms
from lexifold.llm.lexing import terms
from lexifold.runtime import materialise


def log_likelihood(a: float, b: float, c: float, d: float) -> float:
    """Signed log-likelihood ratio of the table [[a, b], [c, d]]; 0 cells add nothing."""
    n = a + b + c + d
    if not n:
        return 0.0
    g = 0.0
    for cell, row, column in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        if cell > 0:
            g += cell * math.log(cell * n / (row * column))
    return math.copysign(max(0.0, 2 * g), a * n - (a + b) * (a + c))


def _log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = a + b + c + d
    cells = ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))
    g = sum(F.when(x > 0, x * F.log(x * n / (r * k))).otherwise(0.0) for x, r, k in cells)
    return F.when(a * n >= (a + b) * (a + c), 1.0).otherwise(-1.0) * F.greatest(F.lit(0.0), 2 * g)


def candidates(key: str, columns: list[str], by: str, top: int | None, n: int, total: int, shared, singles: bool = False):
    """Map task: a record to those of its terms that can be among its best; to all of them if ``top`` is None.

    ``singles`` says that terms of one record count too.
    """
    fewest = 1 if singles else 2
    rarest = math.log(n / fewest) if n > fewest else 0.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, names, counts, sizes, records, occurrences = [], [], [], [], [], []
            for identity, *texts in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
                own = Counter(t for text in texts for t in terms(text))
                size = sum(own.values())
                scored, others = [], []
                for term, count in own.items():
                    if (seen := known.get(term)) is None:
                        others.append((term, count))
                    elif by == "tf_idf":
                        scored.append((count * seen[2], term, count, seen))
                    else:
                        scored.append((log_likelihood(count, seen[1] - count, size - count, total - size - seen[1] + count), term, count, seen))
                floor = -math.inf
                if top is None:
                    pass
                elif len(scored) > top:
                    floor = heapq.nlargest(top, (s[0] for s in scored))[-1] - 2e-6  # scores tie as rounded
                    scored = [s for s in scored if s[0] >= floor]
                elif len(scored) == top:
                    floor = min(s[0] for s in scored) - 2e-6
                best: dict[int, float] = {}
                for term, count in others:
                    if count not in best:
                        best[count] = count * rarest if by == "tf_idf" else log_likelihood(count, fewest - 1, size - count, total - size - fewest + 1)
                    if best[count] >= floor:
                        ids.append(identity), names.append(term), counts.append(count), sizes.append(size)
                        records.append(None), occurrences.append(None)
                for _, term, count, seen in scored:
                    ids.append(identity), names.append(term), counts.append(count), sizes.append(size)
                    records.append(seen[0]), occurrences.append(seen[1])
            yield pa.record_batch(
                [pa.array(ids, batch.column(key).type), pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, sizes, records, occurrences))],
                names=[key, "term", "count", "size", "records", "occurrences"],
            )

    return task


def distinctive_terms(
    texts: DataFrame, key: str, columns: list[str], by: str = "tf_idf", top: int | None = 3, least_records: int = 2, share: float = 0.001, most_shared: int = 100_000
) -> DataFrame:
    """The ``top`` most typical terms of each row (all if None): key, term, count, records, tf_idf, log_likelihood, rank.

    Only terms of at least ``least_records`` rows count.  Scores are rounded to 6 decimals; ties
    go to the smaller term by code points.  Rows without such a term, among them
    those with null, empty or blank texts, give nothing; an empty table gives an
    empty result.  ``key`` must be unique; extra columns are ignored.
    """
    if by not in ("tf_idf", "log_likelihood"):
        raise ValueError(f"unknown score {by!r}")
    if least_records < 1:
        raise ValueError("least_records must be 1 or more")
    spark = texts.sparkSession
    counted, n = count_terms(texts, columns)
    counted = materialise(counted, "terms")
    total = counted.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    counted = counted.filter(F.col("records") >= least_records)
    least = max(float(least_records), n * share)
    while counted.filter(F.col("records") >= least).count() > most_shared:
        least *= 2
    shared = {r[0]: (r[2], r[1], math.log(n / r[2])) for r in counted.filter(F.col("records") >= least).collect()}  # at most most_shared rows
    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(key, *columns).mapInArrow(
        candidates(key, columns, by, top, n, int(total), spark.sparkContext.broadcast(shared), least_records < 2),
        f"`{key}` {kind}, term string, count bigint, size bigint, records bigint, occurrences bigint",
    )
    found = materialise(found, "scored")
    settled = found.filter(F.col("records").isNotNull())
    looked_up = (
        found.filter(F.col("records").isNull())
        .drop("records", "occurrences")
        .join(counted.filter(F.col("records") < least), "term")
        .select(key, "term", "count", "size", "records", "occurrences")
    )
    a, b = F.col("count").cast("double"), (F.col("occurrences") - F.col("count")).cast("double")
    c, d = (F.col("size") - F.col("count")).cast("double"), (F.lit(int(total)) - F.col("size") - F.col("occurrences") + F.col("count")).cast("double")
    scored = settled.unionByName(looked_up).select(
        key,
        "term",
        "count",
        "records",
        F.round(F.col("count") * F.log(F.lit(float(n)) / F.col("records")), 6).alias("tf_idf"),
        F.round(_log_likelihood(a, b, c, d), 6).alias("log_likelihood"),
    )
    order = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col("term"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)

