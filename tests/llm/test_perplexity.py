import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexifold.llm import perplexity as P

WORDS = "the dose was low and the mice were fed with grain until the end of the year when all of them had lost weight".split()


def texts():
    rows = [(k, " ".join(WORDS[(k * 7 + j * j) % len(WORDS)] for j in range(20)), "en") for k in range(60)]
    rows += [(100 + k, "治疗组显著降低血压" * 3, "ZH") for k in range(4)]
    return rows + [(200, "qzx vwj kkq zzq xxj qqv wzx jjq", "en"), (201, "the dose was low " * 30, "EN-us"), (202, None, "en"), (203, " \n", None), (204, "12 .. !", "en"), (204, "12 .. !", "en"), (205, "lone text", None)]


def brute(rows, order):
    """Modified Kneser-Ney by dictionaries: the probability function of each language."""
    top = defaultdict(Counter)
    for tongue, s in rows:
        padded = (P.START,) * (order - 1) + tuple(s)
        for i in range(order - 1, len(padded)):
            top[tongue][padded[i - order + 1 : i + 1]] += 1
    models = {}
    for tongue, level in top.items():
        levels = {order: level}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        discounts = {}
        for k, table in levels.items():
            n = Counter(min(c, 5) for c in table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
            discounts[k] = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if y is not None and n[i] else 0.5 * i for i in (1, 2, 3)]
        models[tongue] = levels, discounts

    def probability(tongue, gram):
        levels, discounts = models[tongue]
        p = 1 / (len(levels[1]) + 1)
        for k in range(1, order + 1):
            g = gram[-k:]
            own = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
            if own:
                total = sum(own.values())
                taken = sum(discounts[k][min(c, 3) - 1] for c in own.values())
                c = own.get(g, 0)
                p = (c - discounts[k][min(c, 3) - 1] if c else 0) / total + taken / total * p
        return p

    return probability


def test_against_dictionaries(spark):
    rows = texts()[:12] + texts()[60:63] + texts()[64:66]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r.perplexity for r in P.perplexity(df, order=3, least=1, at_once=100).collect()}
    held = [({"EN-us": "en", "ZH": "zh"}.get(g, g), P.symbols(t).tolist()) for _, t, g in rows]
    probability = brute(held, 3)
    for (k, *_), (tongue, s) in zip(rows, held):
        padded = (P.START, P.START, *s)
        logs = [math.log(probability(tongue, padded[i - 2 : i + 1])) for i in range(2, len(padded))]
        assert abs(got[k] - math.exp(-sum(logs) / len(logs))) < 1e-3 * got[k]


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(texts()[:20], "doc_id bigint, text string, lang string").withColumn("_lang", P.language("lang"))
    model = P.fit(df, "doc_id", "text", 3, least=1)
    import numpy as np

    seen = sorted({int(c) for _, t, _ in texts()[:20] for c in P.symbols(t)})
    for context in ([97, 110], [1, 1], [122, 122]):
        window = np.array([[*context, c] for c in seen])
        assert abs(model.probabilities(window, ["en"] * len(seen)).sum() - 1) < 0.05


def test_bands(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in texts()], "doc_id bigint, text string, lang string, band string, n int")
    got = P.perplexity(df, low=2.0).collect()
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(texts())
    assert rows[200].band == "high" and rows[201].band == "low" and rows[0].band == "inside" and rows[100].band == "inside"
    assert rows[201].lang == "en" and rows[100].lang == "zh" and rows[203].lang == "und"
    for k in (202, 203, 204):
        assert rows[k].band == "none" and rows[k].perplexity is None
    assert P.perplexity(df.limit(0)).count() == 0


def test_rare_grams_back_off(spark):
    df = spark.createDataFrame(texts(), "doc_id bigint, text string, lang string")
    rows = {r.doc_id: r.perplexity for r in P.perplexity(df, most=150).collect()}
    assert len(rows) == len(texts()) - 1 and all(v is None or v > 1 for v in rows.values())


def test_symbols():
    assert P.symbols("A b,c-D\n é!").tolist() == [97, 32, 98, 32, 99, 32, 100, 32, 233]
    assert P.symbols(None).tolist() == P.symbols("1 2").tolist() == []
    assert F


def test_a_model_beyond_memory_is_whole(spark):
    """Nothing is dropped by default; with arrays in mapped files the model and its results are the same."""
    import numpy as np

    df = spark.createDataFrame(texts(), "doc_id bigint, text string, lang string")
    held = df.withColumn("_lang", P.language("lang"))
    whole, mapped = P.fit(held, "doc_id", "text"), P.fit(held, "doc_id", "text", in_memory=50)
    for name in ("grams", "shares", "contexts", "weights"):
        assert isinstance(getattr(mapped, name), np.memmap) and not isinstance(getattr(whole, name), np.memmap)
        assert len(getattr(mapped, name)) > 100 and np.array_equal(getattr(whole, name), getattr(mapped, name))
    got = [sorted(map(tuple, P.perplexity(df, in_memory=m).fillna(-1.0).collect())) for m in (50, 4_000_000)]
    assert got[0] == got[1]
