import pytest
from pyspark.sql import functions as F

from lexifold.llm import sentences as S

RUNNING = [
    "The trial enrolled forty patients. The dose was low. Results were stable after a year. We saw no change. Dr. Smith agreed with Prof. Jones. It ended at 3 p.m. The team left.",
    "Interest has grown. See Fig. 3 for details. Values rose by 0.5 mg. The unit of Smith et al. reported less. The cost was low.",
    "The rest held. A few mice were lost. The drug, e.g. aspirin, was pure. Some left the U.S. and came back. We waited.",
    "Das Risiko sank. Die Dosis war hoch. Der Wert stieg z. B. im Mai. Die Kohorte blieb.",
    "治疗组显著降低血压。对照样本没有变化。该模型是否有效？无效！",
    "मॉडल ने अवधि को बदला। सीरम स्तर ने उपज को बदला। कोई असर नहीं हुआ!",
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t, None) for k, t in enumerate(RUNNING * 8)]
    return S.fit(spark.createDataFrame(rows, "k bigint, a string, b string"), "k", ["a", "b"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("The dose was low. We saw 0.5 mg in Fig. 3 here. It ended.", ["The dose was low.", "We saw 0.5 mg in Fig. 3 here.", "It ended."]),
        ("RESULTS: The dose was low.[3,4] The rest held.", ["RESULTS: The dose was low.[3,4]", "The rest held."]),
        ('One wrote "Stop. Then go." and signed the form. The cost was low.', ['One wrote "Stop. Then go." and signed the form.', "The cost was low."]),
        ("We waited. (See Table 3 for details.) The rest held.", ["We waited.", "(See Table 3 for details.)", "The rest held."]),
        ("Heading\n\n  The dose was low. \r\nN/A", ["Heading", "The dose was low.", "N/A"]),
        ("治疗组降低血压。（详见表7。）对照样本为7.3，见Fig. 4。无效！", ["治疗组降低血压。", "（详见表7。）", "对照样本为7.3，见Fig. 4。", "无效！"]),
        ("ขนาดยาสูงเท่ากับ0.5 การรักษาลดไข้  ดีมาก", ["ขนาดยาสูงเท่ากับ0.5", "การรักษาลดไข้", "ดีมาก"]),
        ("सीरम स्तर ने उपज को बदला। मॉडल ने अवधि को बदला।", ["सीरम स्तर ने उपज को बदला।", "मॉडल ने अवधि को बदला।"]),
        ("...", ["..."]),
        ("", []),
        (None, []),
        ("  \n ", []),
    ],
)
def test_spans(model, text, want):
    assert [text[a:b] for a, b in S.spans(text, model)] == want


def test_offsets_are_code_points(model):
    text = "😀 The dose was low. The rest held."
    assert [text[a:b] for a, b in S.spans(text, model)][1] == "The rest held."


def test_table(spark, model):
    long = "The dose was low. " * 20_000
    rows = [(1, "The dose was low. The rest held.", None, "x"), (1, "The dose was low. The rest held.", "", "x"), (2, None, " ", "x"), (3, long, "A line\nB line", "x")]
    df = spark.createDataFrame(rows, "k bigint, a string, b string, part string")
    got = S.sentences(df, "k", ["a", "b"], model)
    assert got.filter("k = 1").count() == 4 and got.filter("k = 2").count() == 0
    assert got.filter("k = 3 and part = 'a'").count() == 20_000 and [r.sentence for r in got.filter("k = 3 and part = 'b'").orderBy("sentence_no").collect()] == ["A line", "B line"]
    assert S.sentences(df.limit(0), "k", ["a", "b"]).count() == 0


def test_spans_of_quotes():
    assert S.closed_spans('a "b (c" d) „e“ “f” «g» 「h」') == [(2, 7), (12, 14), (16, 18), (20, 22), (24, 26)]
    assert S.closed_spans("open ( only") == []


LANGUAGES = {
    "en": (["The mice", "A patient", "We", "Most sites", "Few cells"], ["gained", "lost", "showed", "kept", "needed"], ["more weight after surgery", "little sleep in winter", "new lesions at baseline", "stable values for years"], " ", "."),
    "ar": (["الفريق", "المريض", "الباحثون", "الدواء"], ["خفض", "أظهر", "قاس", "رفع"], ["ضغط الدم بعد العلاج", "مستوى السكر في المصل", "مدة النوم عند الأطفال"], " ", "."),
    "zh": (["治疗组", "对照组", "研究者", "该模型"], ["降低了", "提高了", "观察到", "测量了"], ["患者的血压", "血清的浓度", "睡眠的时间", "肿瘤的大小"], "", "。"),
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_text_without_terminators(spark, language):
    """Boundaries come from the words alone."""
    import random

    rnd = random.Random(7)
    *parts, blank, end = LANGUAGES[language]
    sentence = lambda: blank.join(rnd.choice(p) for p in parts)
    rows = [(k, blank.join(sentence() + end for _ in range(rnd.randint(1, 4))), None) for k in range(400)]
    learnt = S.fit(spark.createDataFrame(rows, "k bigint, a string, b string"), "k", ["a", "b"])
    true = found = both = 0
    for _ in range(40):
        said = [sentence() for _ in range(6)]
        said = [x.lower() for x in said] if language == "en" else said
        joined = blank.join(said)
        ends = {sum(map(len, said[:k])) + len(blank) * (k - 1) for k in range(1, 6)}
        got = {b for _, b in S.spans(joined, learnt)} - {len(joined)}
        true, found, both = true + len(ends), found + len(got), both + len(ends & got)
    assert both > 0.9 * true and both > 0.9 * found


def test_thai_parts_at_blanks(model):
    assert [b for _, b in S.spans("ผู้ป่วยได้รับยา การรักษาลดไข้ ค่าเฉลี่ยต่ำ", model)] == [15, 29, 42]


def test_short_lines_stay_whole(model):
    for text in ("Methods and materials of the second trial", "N/A", "治疗组对照样本"):
        assert [text[a:b] for a, b in S.spans(text, model)] == [text]


def test_rare_entries_back_off_to_fit_the_model(spark):
    """A bound on the model's size lets rare contexts back off; every row is still counted and cut."""
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(RUNNING * 8)], "k bigint, a string, b string")
    survey = S._surveyed(df, "k", ["a", "b"], False).cache()
    small = S.learnt(survey, most=20)
    assert len(small.contexts) <= 21 and len(small.words) <= 21
    assert S.sentences(df, "k", ["a", "b"], small).groupBy("k").count().count() == len(RUNNING) * 8


def test_learns_from_all_rows(spark):
    """An abbreviation that only rows outside a hash share of 6,000 hold is learnt, and as in one process."""
    n = 9_000
    inside = {r[0] for r in spark.range(n).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int((1 << 31) * 6_000 / n)).collect()}
    outside = [k for k in range(n) if k not in inside][:1_500]
    rare = set(outside)
    rows = [(k, "The dose was given by fzq. The mice were low." if k in rare else RUNNING[k % len(RUNNING)], None) for k in range(n)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string").repartition(4)
    got = S.sentences(df, "k", ["a", "b"]).cache()
    assert got.filter(F.col("k").isin(outside)).count() == len(outside)
    alone = S.sentences(df, "k", ["a", "b"], S.fit(df, "k", ["a", "b"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.collect()))


def test_a_model_beyond_memory_is_whole(spark):
    """Nothing is dropped by default; with arrays in mapped files the model and its sentences are the same."""
    import numpy as np

    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(RUNNING * 8)], "k bigint, a string, b string").repartition(4)
    survey = S._surveyed(df, "k", ["a", "b"], False).cache()
    whole, mapped = S.learnt(survey), S.learnt(survey, held=20)
    assert isinstance(mapped.contexts, np.memmap) and isinstance(mapped.behind, np.memmap) and not isinstance(whole.contexts, np.memmap)
    assert len(mapped.contexts) > 80 and len(mapped.words) > 21
    for name in ("contexts", "words", "seen", "ends"):
        assert np.array_equal(getattr(whole, name), getattr(mapped, name))
    for name in ("yes", "behind", "other"):
        assert np.allclose(getattr(whole, name), getattr(mapped, name), rtol=1e-9, atol=1e-9)
    got = [sorted(map(tuple, S.sentences(df, "k", ["a", "b"], m).collect())) for m in (whole, mapped)]
    assert got[0] == got[1]
