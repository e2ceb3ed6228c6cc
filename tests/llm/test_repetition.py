import random

import numpy as np
import pytest

from lexifold.llm import repetition as R


def brute(text, run):
    s = "".join(filter(str.isalpha, (text or "").lower()))
    seen, marked = set(), set()
    for i in range(len(s) - run + 1):
        if s[i : i + run] in seen:
            marked.update(range(i, i + run))
        seen.add(s[i : i + run])
    return len(s), len(marked)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    out = [None, "", "  ", "1 2 3", "a" * 39, "a" * 41, "x" * 3000, "Straße İß" * 30, "日本語の文" * 40]
    for _ in range(60):
        part = "".join(rnd.choices("ab c", k=rnd.randint(1, 80)))
        out.append(" ".join(rnd.choice([part, "".join(rnd.choices("abcdefgh", k=30))]) for _ in range(rnd.randint(1, 12))))
    return out


@pytest.mark.parametrize("run, at_once", [(40, 1 << 20), (5, 50), (5, 1 << 20)])
def test_letters(texts, run, at_once):
    got = R.repeated_letters([R.letters(t) for t in texts], run, at_once)
    assert list(got) == [brute(t, run)[1] for t in texts]


def test_collisions(monkeypatch, texts):
    """Hashes that all meet are settled letter by letter."""
    monkeypatch.setattr(R, "_powers", lambda base, n: np.zeros(n, np.uint64))
    got = R.repeated_letters([R.letters(t) for t in texts[-8:]], 5)
    assert list(got) == [brute(t, 5)[1] for t in texts[-8:]]


def test_table(spark, texts):
    rows = [(k, t, 0.5) for k, t in enumerate([*texts, texts[-1], "ab " * 200_000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = {r.doc_id: (r.n_letters, r.n_repeated) for r in R.repetition(df, at_once=5000).collect()}
    assert got == {k: brute(t, 40) for k, t, _ in rows}
    assert R.repetition(df.limit(0)).count() == 0
