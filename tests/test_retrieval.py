import re

import pytest
from pyspark.sql import functions as F

from lexifold.operators import catalog as C
from lexifold.operators import documents as D
from lexifold.operators import embedding as E
from lexifold.operators import index as N
from lexifold.operators import search as S
from lexifold.operators import spelling as L
from lexifold.operators import zipf as Z

ARTICLES = "collection_id string, article_id string, article_no bigint, title string, abstract string, body string, filename string, doi string, journal string, id string"


def articles(spark, rows):
    return spark.createDataFrame([(c, i, n, t, a, b, "f.xml", None, None, "clash") for c, i, n, t, a, b in rows], ARTICLES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("x", "d1", 1, "One", "cancer treatment", None),
        ("x", "d2", 2, None, "cancer cancer gene", ""),
        ("x", "d3", 3, " ", "the gene", None),
        ("x", "d2", 4, "again", "another", None),
        ("y", "d1", 5, "Other", None, "cancer cells\nin the body"),
        ("y", "gone", 6, "Gone", "cancer", None),
    ]
    deleted = spark.createDataFrame([("y", "gone"), ("y", "gone"), ("x", "never")], "collection_id string, article_id string")
    return D.active(articles(spark, rows), deleted).cache()


def test_active(docs):
    rows = {(r.collection_id, r.id): r for r in docs.collect()}
    assert set(rows) == {("x", "d1"), ("x", "d2"), ("x", "d3"), ("y", "d1")}
    assert rows["x", "d2"].article_no == 2 and rows["x", "d2"].title == rows["x", "d3"].title == "(Untitled)" and rows["y", "d1"].abstract == ""


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    N.write_index(docs, f"{path}/held")
    return N.open_index(spark, f"{path}/held")


def test_index(spark, docs, index, tmp_path):
    """The written postings are those counted from the texts; an empty collection gives an empty index."""
    key = lambda df: sorted(map(tuple, df.select("collection_id", "id", "term", "tf").collect()))
    assert key(index.postings.filter("tf > 0")) == key(N.postings(docs))
    full = lambda df: sorted(map(tuple, df.select("collection_id", "id", "term", "tf_abstract", "tf_body").collect()))
    assert full(index.postings) == full(N.stem_frequencies(docs))
    assert sorted(map(tuple, index.topics.collect())) == sorted(map(tuple, N.statistics(docs).collect()))
    N.write_index(docs.limit(0), str(tmp_path / "none"))
    none = N.open_index(spark, str(tmp_path / "none"))
    assert S.search(none, "cancer", "OR").count() == S.search(none, "the cancer", "PHRASE").count() == 0


def test_search_plan(spark, index):
    """A search reads its terms' postings through a pushed filter, and no Python."""
    for mode in S.MODES:
        plan = S.hits(index, "cancer of the gene", mode)._jdf.queryExecution().toString()
        assert re.search(r"PushedFilters: \[[^\]]*(?:In\(term|EqualTo\(term)", plan) and "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    plan = S.search(index, "cancer", "OR", top=100)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bm25(index):
    got = [(r.id, r.score, r["rank"]) for r in S.search(index, "cancer", "OR").filter("collection_id = 'x'").orderBy("rank").collect()]
    # N=3, df=2; lengths 2, 3, 1, so the average is 2
    assert got == [("d2", 0.566580, 1), ("d1", 0.470004, 2)]


def test_modes(index):
    ids = lambda q, m, d=None: sorted((r.collection_id, r.id) for r in S.search(index, q, m, d).collect())
    assert ids("cancer gene", "AND") == [("x", "d2")]
    assert set(ids("cancer gene", "AND")) <= set(ids("cancer gene", "OR"))
    assert ids("the of", "OR") == [] and ids("cancer zzz", "AND") == [] and ids("", "PHRASE") == []
    assert ids("in the", "PHRASE") == [("y", "d1")] and ids("cells in", "PHRASE") == []
    assert ids("cancer", "OR", "d1") == [("x", "d1"), ("y", "d1")] and ids("cancer", "OR", "nope") == []
    assert {r.id for r in S.search(index, "cancer", "OR", "nope", unknown="all").collect()} == {"d1", "d2"}
    for bad in ({"mode": "NEAR"}, {"unknown": "some"}):
        with pytest.raises(ValueError):
            S.search(index, "x", **bad)


def test_marks(docs):
    got = docs.filter("id = 'd2'").select(S.highlight("Cancers & <x>")("abstract")).first()[0]
    assert got == "<mark>cancer</mark> <mark>cancer</mark> gene"
    cut = N.whole_text(docs.filter("id = 'd3'")).select(S.snippet("gene", 2, 6)("text")).first()[0]
    assert cut == "…e <mark>gene</mark>"


def test_numbers(spark, docs):
    stored = spark.createDataFrame([("x", "d3", 1), ("x", "d1", 3), ("x", "stale", 9)], "collection_id string, article_id string, doc_number bigint")
    got = {(r.collection_id, r.id): r.number for r in D.numbered(docs, stored).collect()}
    assert got == {("x", "d3"): 1, ("x", "d1"): 2, ("x", "d2"): 3, ("y", "d1"): 1}


def test_statistics(docs):
    assert {(r.collection_id, r.documents, r.avg_length) for r in N.statistics(docs).collect()} == {("x", 3, 2.0), ("y", 1, 3.0)}
    assert N.postings(docs).agg(F.sum("tf")).first()[0] == N.lengths(docs).agg(F.sum("length")).first()[0]


def test_regression(spark):
    points = spark.createDataFrame([("a", 1, 4), ("a", 2, 2), ("a", 3, 1), ("b", 1, 2), ("b", 2, 2), ("c", 1, 5)], "g string, rank bigint, cf bigint")
    got = {r.g: r for r in Z.fit(points, ["g"]).collect()}
    assert (got["a"].slope, got["a"].intercept, got["a"].r_squared, got["a"].rmse) == (-1.233662, 0.621022, 0.977654, 0.036742)
    assert (got["b"].slope, got["b"].r_squared, got["b"].rmse) == (0, 0, 0) and got["c"].intercept == 0


def test_regions_and_terms(docs):
    got = {(r.collection_id, r.region) for r in Z.regions(docs, "B").collect()}
    assert ("x", "high") in got
    assert Z.query_term("The Cancers", "D") == "cancer"
    for bad in ("the", "two words"):
        with pytest.raises(ValueError):
            Z.query_term(bad, "C")
    assert Z.summary(docs, "B").filter("collection_id = 'y'").first().total_tokens == 0


def test_spelling(spark, docs):
    words = spark.createDataFrame([("x", w) for w in ("cancr", "cancer", "th", "zzzz", "gen3", "treatmant")], "collection_id string, word string")
    got = {r.word: r.suggestion for r in L.suggestions(words, L.vocabulary(docs)).collect()}
    assert got == {"cancr": "cancer", "cancer": "cancer", "th": "th", "zzzz": "zzzz", "gen3": "gen3", "treatmant": "treatment"}
    pairs = spark.createDataFrame([("cancr", "cancer"), ("abc", "xyzzy")], "a string, b string")
    assert sorted(r[0] for r in pairs.select(L.edit_distance(F.col("a"), F.col("b"), 2)).collect()) == [1, 3]
    fixed = L.corrected(spark.createDataFrame([("x", "cancr gene")], "collection_id string, query string"), L.vocabulary(docs)).first()
    assert (fixed.corrected, fixed.changes) == ("cancer gene", "cancr>cancer")


def test_embeddings(spark):
    rows = [("x", f"d{k}", k, "t", "alpha beta gamma alpha beta delta", None) for k in range(6)] + [("y", "e", 9, "t", "alone", None)]
    held = D.uniform(articles(spark, rows))
    vocab = E.vocabulary(held)
    assert [r.word for r in vocab.filter("collection_id = 'x'").orderBy("place").collect()] == ["alpha", "beta", "gamma", "delta"]
    pairs = E.skipgram_pairs(E.sequences(held, vocab), 1)
    assert pairs.count() == 6 * 10
    for model in E.MODELS:
        trained = E.train(held, model, dimension=8, epochs=1, tasks=2).collect()
        assert len(trained) == 4 and all(abs(sum(v * v for v in r.vector) - 1) < 1e-9 for r in trained)
    assert E.train_cbow(held, dimension=8, epochs=1, tasks=2).count() == 4 == E.train_skipgram(held, dimension=8, epochs=1, tasks=2).count()
    asked = spark.createDataFrame([("x", "alpha"), ("x", "gamm"), ("x", "zzz")], "collection_id string, word string")
    found = {r.word: r.suggestion for r in E.hints(asked, vocab, L.vocabulary(held)).collect()}
    assert found == {"gamm": "gamma", "zzz": None}
    sized = spark.createDataFrame([(0, True), (0, False), (10**9, False)], "n bigint, q boolean").select(E.radius("n", F.col("q")).alias("r"))
    assert [r.r for r in sized.collect()] == [7.0, 3.3, 6.0]
    plan = pairs._jdf.queryExecution().toString()
    assert "array_contains" not in plan
    with pytest.raises(ValueError):
        E.validate("glove")


def test_nearest(spark):
    rows = [(k, "ab"[k % 2], [float(k), 1.0, 2.0]) for k in range(40)] + [(90, "a", None), (91, "a", [0.0, 0.0, 0.0]), (92, "b", [1.0])]
    vectors = spark.createDataFrame(rows, "k bigint, g string, v array<double>")
    for by in ([], ["g"]):
        got = {(r["query"], r.k): r["rank"] for r in E.nearest(vectors, vectors.filter("k % 3 = 0 or k = 91"), by, "k", "v", 4, block=5).collect()}
        import numpy as np

        unit = {k: np.array(v) / np.linalg.norm(v) for k, _, v in rows[:40]}
        want = {}
        for q in range(0, 40, 3):
            near = sorted((k for k in unit if k != q and (not by or k % 2 == q % 2)), key=lambda k: (-round(float(unit[q] @ unit[k]), 6), k))
            want |= {(q, k): n for n, k in enumerate(near[:4], 1)}
        assert got == want
    assert E.nearest(vectors.limit(0), vectors.limit(0), [], "k", "v").count() == 0


def test_projection(spark):
    rows = [(k, [float(k), 2.0 * k + (k % 2), 0.5]) for k in range(10)]
    points, shares = E.projection(spark.createDataFrame(rows, "k bigint, v array<double>"), "k", "v")
    xs = [r.x for r in points.collect()]
    assert abs(sum(xs)) < 1e-4 and shares[0] > shares[1] >= 0 and sum(shares) <= 1 + 1e-9
    none, zero = E.projection(spark.createDataFrame(rows[:2], "k bigint, v array<double>"), "k", "v")
    assert none.count() == 0 and zero == (0.0, 0.0)


def test_catalogue(spark, docs):
    log = spark.createDataFrame([("x", "pubmed", "Q", 0, 999), ("x", "pubmed", "q", 999, 48), ("x", "arxiv", None, None, None)], "collection_id string, source string, query_text string, retstart int, downloaded int")
    assert {(r.source, r.query): r.next_offset for r in C.next_offsets(log).collect()} == {("pubmed", "q"): 1047, ("arxiv", ""): 0}
    topics = spark.createDataFrame([], "collection_id string, title string, default_query string, source string, source_queries map<string,string>, created_at timestamp, document_count int")
    topics = C.created(topics, "  Gut   peptides ", "q")
    assert topics.first().title == "Gut peptides" and topics.first().collection_id.startswith("gut-peptides-")
    for bad in ("gut PEPTIDES", "", "x" * 81):
        with pytest.raises(ValueError):
            C.created(topics, bad)
    assert C.without(docs, "x").count() == 1
    with pytest.raises(ValueError):
        C.deletion(docs, "x", "nope")
    assert C.deletion(docs, "x", "d1").count() == 1


def test_catalogue_reads(spark):
    schema = "collection_id string, title string, default_query string, source string, source_queries map<string,string>, created_at timestamp, document_count int"
    from datetime import datetime

    rows = [("b", "B", None, None, None, datetime(2024, 1, 2), None), ("a", "A", "q", "arxiv", {"arxiv": "q"}, datetime(2024, 1, 3), 4), ("c", "C", "q", "pubmed", None, None, 1)]
    topics = spark.createDataFrame(rows, schema)
    listed = {r.id: r for r in C.listed(topics).collect()}
    assert listed["b"].query == "" and listed["b"].source == "pubmed" and listed["b"].source_queries == {"pubmed": ""} and listed["b"]["count"] == 0
    assert C.topic(topics, "a").first().title == "A" and C.exists(topics, "a") and not C.exists(topics, "z")
    assert C.first_id(topics) == "b" and C.active_topic(topics, "c") == "c" and C.active_topic(topics, "z") == C.active_topic(topics) == "b"
    assert C.first_id(topics.limit(0)) is None and C.active_topic(topics.limit(0), "a") is None


def test_batches(spark):
    lists = [(1, "PMID: 7, 8;7"), (2, " "), (3, None), (4, "7 x9 y"), (5, " ".join(map(str, range(1, 203)))), (6, "arXiv:2010.11929v2，hep-th/9901001 2010.11929"), (7, "2010.1"), (None, "5")]
    df = spark.createDataFrame(lists, "k int, l string")
    got = {r.k: (r.ids, r.duplicates, r.error) for r in C.batch_report(df, "k", "l").collect()}
    assert got[1] == (["7", "8"], 1, None) and got[2] == got[3] == ([], 0, "empty") and got[4] == ([], 0, "invalid: x9") and got[5] == ([], 0, "more than 200") and got[None] == (["5"], 0, None)
    got = {r.k: (r.ids, r.duplicates, r.error) for r in C.batch_report(df.filter("k > 5"), "k", "l", "arxiv").collect()}
    assert got == {6: (["2010.11929", "hep-th/9901001"], 1, None), 7: ([], 0, "invalid: 2010.1")}


def test_casefold(spark):
    from lexifold.functions import sql

    sql.register(spark)
    words = "ΣΊΣΥΦΟΣ Straße ﬁn"
    assert spark.createDataFrame([(w,) for w in words.split()], "w string").selectExpr("casefold(w) AS f").collect()[0].f == "ΣΊΣΥΦΟΣ".casefold()
    assert [r.f for r in spark.createDataFrame([("ﬁn",), (None,)], "w string").selectExpr("casefold(w) AS f").collect()] == ["fin", None]


def test_training_follows_every_update(spark):
    """Against scalar loops: each word drawn is met with what the updates before it left."""
    import math

    import numpy as np

    n = np.array([9, 5, 4, 2])
    for examples in ([([0], 1), ([1], 2), ([2], 0), ([3], 1)] * 5, [([0, 1, 1], 2), ([2, 3], 0), ([1], 3)] * 5):
        dimension, epochs, negatives, seed = 8, 2, 3, 7
        draw = np.random.default_rng(seed)
        inner = draw.uniform(-0.5 / dimension, 0.5 / dimension, (4, dimension)).tolist()
        outer = [[0.0] * dimension for _ in n]
        sums = np.cumsum(n**0.75)
        for epoch in range(epochs):
            order = draw.permutation(len(examples))
            drawn = draw.random((len(examples), negatives)) * sums[-1]
            rate = 0.035 * (1 - 0.35 * epoch / max(1, epochs - 1))
            for k, values in zip(order, drawn):
                sources, target = examples[k]
                words = [target]
                for v in values:
                    word = int(np.searchsorted(sums, v))
                    words.append((word + 1) % 4 if word == target else word)
                for place, word in enumerate(words):
                    hidden = [sum(inner[s][d] for s in sources) / len(sources) for d in range(dimension)]
                    score = max(-8.0, min(8.0, sum(h * o for h, o in zip(hidden, outer[word]))))
                    gradient = rate * ((place == 0) - 1 / (1 + math.exp(-score)))
                    old = outer[word][:]
                    outer[word] = [o + gradient * h for o, h in zip(old, hidden)]
                    for s in sources:
                        inner[s] = [x + gradient * o / len(sources) for x, o in zip(inner[s], old)]
        unit = np.array(inner) / np.linalg.norm(inner, axis=1, keepdims=True)
        assert np.allclose(E._train(examples, n, dimension, epochs, negatives, seed), unit, atol=1e-12)


def test_projection_against_eigenvectors(spark):
    import numpy as np

    rnd = np.random.default_rng(4)
    values = rnd.normal(size=(40, 5)) * [5, 3, 1, 0.5, 0.1]
    points, shares = E.projection(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "k bigint, v array<double>"), "k", "v")
    centred = values - values.mean(axis=0)
    sizes, axes = np.linalg.eigh(np.cov(centred.T))
    axes = axes[:, ::-1][:, :2]
    axes *= np.where(1 / np.arange(1, 6) @ axes < 0, -1, 1)
    got = {r.k: (r.x, r.y) for r in points.collect()}
    assert np.allclose([got[k] for k in range(40)], centred @ axes, atol=2e-6)
    assert np.allclose(shares, sizes[::-1][:2] / sizes.sum())
