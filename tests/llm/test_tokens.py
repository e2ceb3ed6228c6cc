import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifold.llm import bpe, mixing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{bpe.TOKENIZERS}/{bpe.NAME}.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES.pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(exact, text):
    text = text.encode("utf-8", "replace").decode()
    assert bpe.tokenizer().ids(text) == exact.encode_ordinary(text)


def test_long_pieces(exact):
    rnd = random.Random(1)
    for text in ("a" * 5000, "abcd" * 2000, "ทดสอบ" * 500, "".join(rnd.choices("aeitnos", k=5000)), "<|endoftext|>", "\0\n \t"):
        assert bpe.tokenizer().ids(text) == exact.encode_ordinary(text)
        assert bpe.tokenizer().length(text) == len(exact.encode_ordinary(text))


def test_encode(spark, exact):
    rows = [(1, "Some text"), (2, None), (3, ""), (4, "  "), (5, "Some text"), (5, "word " * 30_000)]
    df = spark.createDataFrame([(*r, [7]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = bpe.encode(df, rows=2)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((k, exact.encode_ordinary(t) if t else []) for k, t in rows)
    assert bpe.encode(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(2)
    rows = [(k, "word " * rnd.randint(1, 60), rnd.choice(["big", " Big", "BIG ", "small"]) if k % 20 else "tiny") for k in range(400)]
    rows += [(1000, None, "big"), (1001, " ", "small"), (1002, "some text", None), (1003, "more text", "other")]
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, copies int")


def test_mixture(spark, documents):
    plans = [("p", "Big", 0.5, 1), ("p", "small", 0.2, 2), ("p", "tiny ", 0.25, 2), ("p", "absent", 0.05, 9), ("q", "tiny", 0.9, 20), ("q", "small", 0.1, None), ("r", "big", None, 3)]
    targets = spark.createDataFrame(plans, "plan_id string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(documents, targets)
    sized = {r.doc_id: (r.source, r.n_tokens) for r in mixing.sized_documents(documents).collect()}
    places = {r.doc_id: r.place for r in mixing.sized_documents(documents).collect()}
    sizes = {s: sum(n for x, n in sized.values() if x == s) for s in ("big", "small", "tiny", "absent")}
    got = {(r.plan_id, r.source): r for r in shares.collect()}
    taken = {}
    for r in chosen.collect():
        taken.setdefault((r.plan_id, r.source), {})[r.doc_id] = r.copies
    for plan, source, share, cap in plans:
        source = source.strip().lower()
        total = sum(sizes[s.strip().lower()] for p, s, *_ in plans if p == plan)
        target, row, held = (share or 0) * total, got[plan, source], taken.get((plan, source), {})
        tokens = sum(c * sized[d][1] for d, c in held.items())
        assert (row.size, row.taken_tokens) == (sizes[source], tokens) and abs(row.target_tokens - target) < 1e-6
        if sizes[source] * (cap or 0) < target:
            assert tokens == sizes[source] * (cap or 0)
        elif sizes[source]:
            own = sorted((places[d], d) for d, (s, _) in sized.items() if s == source)
            whole = int(target // sizes[source])
            once_more = [d for _, d in own if held.get(d, 0) > whole]
            assert once_more == [d for _, d in own][: len(once_more)] and tokens <= target
            if len(once_more) < len(own):
                assert tokens + sized[own[len(once_more)][1]][1] > target
    short = {(r.plan_id, r.source) for r in mixing.short_sources(documents, targets).collect()}
    assert short == {("p", "tiny"), ("p", "absent"), ("q", "small")}


def test_nothing_to_mix(spark, documents):
    targets = spark.createDataFrame([("p", "big", 1.0, 1)], "plan_id string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(documents.limit(0), targets)
    assert chosen.count() == 0 and shares.first().taken_tokens == 0
    chosen, shares = mixing.mixture(documents, targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0
    assert mixing.mixture(documents, targets)[0].agg(F.sum("copies")).first()[0] == documents.filter("lower(trim(source)) = 'big' and trim(text) <> ''").count()
