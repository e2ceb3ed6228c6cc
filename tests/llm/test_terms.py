import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexifold.llm import burst, distinctive, queries
from lexifold.llm.lexing import terms
from lexifold.llm.queries import banded


def test_terms():
    assert terms("HIV-1's 0.65; 1.2.3 a--b Straße l’eau x_y ٣.٤") == ["hiv-1's", "0.65", "1.2.3", "a", "b", "strasse", "l’eau", "x", "y", "٣.٤"]
    assert terms(None) == terms("") == terms(" \n") == []


def test_trie():
    rnd = random.Random(1)
    names = ["".join(rnd.choices("abc", k=k % 6 + 1)) for k in range(900)] + ["x" * 3000, "x" * 3001, "x" * 3002]
    for capacity in (1, 4, 5000):
        trie = burst.Trie(capacity)
        for n in names:
            trie.add(n, 2, 1)
        held = [(path + s, *c) for path, container in trie.containers() for s, c in container]
        assert held == sorted((n, 2 * k, k) for n, k in Counter(names).items())
        assert all(len(c) <= capacity for _, c in trie.containers()) and trie.size == len(held)


def test_tries_merge_by_subtrees():
    """Containers of tries of any depths, in any order, make the trie of all terms."""
    rnd = random.Random(2)
    names = [["".join(rnd.choices("abcd", k=rnd.randint(1, 7))) for _ in range(300)] for _ in range(6)]
    for capacity in (1, 7, 1000):
        hung = []
        for k, own in enumerate(names):
            trie = burst.Trie((1, 3, 50)[k % 3])
            for n in own:
                trie.add(n, 3, 1)
            hung += [(path, [s for s, _ in held], [c[0] for _, c in held], [c[1] for _, c in held]) for path, held in trie.containers()]
        rnd.shuffle(hung)
        whole = burst.Trie(capacity)
        for container in hung:
            whole.hang(*container)
        want = Counter(n for own in names for n in own)
        assert {path + s: tuple(c) for path, held in whole.containers() for s, c in held} == {n: (3 * k, k) for n, k in want.items()}
        assert whole.size == len(want)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(1, 5))) for _ in range(150)] + ["the"] * 80
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 30))) or None, rnd.choice(["", " ", None, "the tail"])) for k in range(200)]
    rows += [(200 + k, "the same", "the same") for k in range(100)]  # a third holds one text
    rows.append((999, "word " * 50_000, None))
    return rows


@pytest.mark.parametrize("capacity, fanout, most", [(3, 4, 50), (2048, 512, 10**6), (1, 1, 10)])
def test_counts(spark, corpus, capacity, fanout, most):
    df = spark.createDataFrame([(*r, "clash", 1) for r in corpus], "k bigint, a string, b string, term string, records int").repartition(5)
    got, n = burst.count_terms(df, ["a", "b"], capacity, fanout, 3, most)
    occurrences, records = Counter(), Counter()
    for _, *texts in corpus:
        found = [t for x in texts for t in terms(x)]
        occurrences.update(found)
        records.update(set(found))
    rows = got.collect()
    assert len(rows) == len({r.term for r in rows})
    assert {r.term: (r.occurrences, r.records) for r in rows} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert n == sum(any(terms(x) for x in texts) for _, *texts in corpus)


def test_empty(spark):
    none = spark.createDataFrame([], "k bigint, a string, b string")
    got, n = burst.count_terms(none, ["a", "b"])
    assert got.count() == 0 and n == 0
    assert distinctive.distinctive_terms(none, "k", ["a", "b"]).count() == 0
    blank = spark.createDataFrame([(1, None, " "), (2, "", None)], "k bigint, a string, b string")
    assert distinctive.distinctive_terms(blank, "k", ["a", "b"]).count() == 0


def test_bands(spark):
    counted = spark.createDataFrame([("a", 9, 1), ("b", 9, 3), ("c", 9, 8)], "term string, occurrences bigint, records bigint")
    assert {r.term: r.band for r in banded(counted, 64).collect()} == {"a": "rare", "b": "useful", "c": "common"}


@pytest.mark.parametrize("share", [0.0001, 0.05, 0.9])
@pytest.mark.parametrize("by", ["tf_idf", "log_likelihood"])
def test_distinctive(spark, corpus, share, by):
    df = spark.createDataFrame([(*r, "clash", 1) for r in corpus], "k bigint, a string, b string, term string, records int").repartition(3)
    held = {k: Counter(t for x in texts for t in terms(x)) for k, *texts in corpus}
    held = {k: c for k, c in held.items() if c}
    records, occurrences = Counter(t for c in held.values() for t in c), sum(held.values(), Counter())
    total = sum(occurrences.values())
    want = {}
    for k, c in held.items():
        size = sum(c.values())
        score = lambda t: round(c[t] * math.log(len(held) / records[t]), 6) if by == "tf_idf" else round(distinctive.log_likelihood(c[t], occurrences[t] - c[t], size - c[t], total - size - occurrences[t] + c[t]), 6)
        want[k] = [t for _, t in sorted((-score(t), t) for t in c if records[t] >= 2)[:3]]
    got = distinctive.distinctive_terms(df, "k", ["a", "b"], by, share=share, most_shared=20)
    rows = got.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t")).collect()
    assert {r.k: [x.term for x in r.t] for r in rows} == {k: v for k, v in want.items() if v}


def test_log_likelihood():
    assert distinctive.log_likelihood(10, 10, 10, 10) == 0
    assert distinctive.log_likelihood(0, 10, 10, 10) < 0 < distinctive.log_likelihood(10, 0, 10, 10)
    with pytest.raises(ValueError):
        distinctive.distinctive_terms(None, "k", [], by="x")


@pytest.mark.parametrize("by", ["tf_idf", "log_likelihood"])
def test_all_terms_scored(spark, corpus, by):
    """Every term of every row, those of a single row too; with a top, these can be among the best."""
    df = spark.createDataFrame(corpus, "k bigint, a string, b string").repartition(3)
    held = {k: Counter(t for x in texts for t in terms(x)) for k, *texts in corpus}
    held = {k: c for k, c in held.items() if c}
    records, occurrences = Counter(t for c in held.values() for t in c), sum(held.values(), Counter())
    total = sum(occurrences.values())
    want = {}
    for k, c in held.items():
        size = sum(c.values())
        for t in c:
            ratio = distinctive.log_likelihood(c[t], occurrences[t] - c[t], size - c[t], total - size - occurrences[t] + c[t])
            want[k, t] = (c[t], records[t], c[t] * math.log(len(held) / records[t]), ratio)
    got = {(r.k, r.term): r for r in distinctive.distinctive_terms(df, "k", ["a", "b"], by, None, 1, 0.05, 20).collect()}
    assert 1 in records.values() and got.keys() == want.keys()
    assert all((r["count"], r.records) == want[key][:2] and (r.tf_idf, r.log_likelihood) == pytest.approx(want[key][2:], abs=2e-6) for key, r in got.items())
    top = {(r.k, r.term) for r in distinctive.distinctive_terms(df, "k", ["a", "b"], by, 2, 1, 0.05, 20).collect()}
    assert top == {key for key, r in got.items() if r["rank"] <= 2}


def test_log_likelihood_query(spark, tmp_path):
    rows = [(1, "parsed", "alpha beta gamma delta alpha", None), (2, "parsed", "alpha", "beta"), (3, "as_received", "omega", None)]
    spark.createDataFrame(rows, "article_no bigint, text_state string, abstract string, body string").write.parquet(f"{tmp_path}/articles.parquet")
    got = {(r.article_no, r.term) for r in queries.p5_log_likelihood(spark, str(tmp_path)).collect()}
    assert got == {(1, "alpha"), (1, "beta"), (1, "gamma"), (1, "delta"), (2, "alpha"), (2, "beta")}
