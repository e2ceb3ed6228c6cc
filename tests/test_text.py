import pytest
from pyspark.sql import functions as F

from lexifold.functions import ids as I
from lexifold.functions import text as X
from lexifold.functions.porter import stem, stems

PORTER = """caresses caress, ponies poni, cats cat, feed feed, agreed agre, plastered plaster, motoring motor, sing sing, conflated conflat, troubled troubl,
sized size, hopping hop, falling fall, fizzed fizz, filing file, happy happi, sky sky, relational relat, conditional condit, digitizer digit, vietnamization vietnam,
hopefulness hope, formaliti formal, triplicate triplic, electrical electr, goodness good, revival reviv, allowance allow, adoption adopt, effective effect,
probate probat, rate rate, cease ceas, controll control, roll roll, generalizations gener, oscillators oscil, hiv-1 hiv-1, über über, is is, strasse strass"""


@pytest.mark.parametrize("pair", PORTER.split(","))
def test_porter(pair):
    word, want = pair.split()
    assert stem(word) == want


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()[0]


def test_tokens(spark):
    assert one(spark, "HIV-1 costs 0.65; 0.44–0.97 a_b Straße", X.tokens) == ["hiv-1", "costs", "0.65", "0.44", "0.97", "a", "b", "strasse"]
    assert one(spark, "", X.tokens) == []
    assert one(spark, None, X.tokens) is None
    assert one(spark, "The using of cats", lambda c: stems(X.without_stop_words(X.tokens(c)))) == ["cat"]
    assert one(spark, "Well, (p<0.05) -- OK.", X.basic_tokens) == ["well,", "(p<0.05)", "ok."]


@pytest.mark.parametrize(
    "text, want",
    [
        ("See Fig. 2. Done e.g. here. X", ["See Fig. 2.", "Done e.g. here.", "X"]),
        ("A line\n\n Another one! \r\nIt grew by 0.5. (Why?) Yes.", ["A line", "Another one!", "It grew by 0.5.", "(Why?)", "Yes."]),
        ("J. R. Smith saw it. In the U.S. and later.", ["J.", "R. Smith saw it.", "In the U.S. and later."]),
        ("", []),
        ("   ", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, X.sentences) == want


def test_ids(spark):
    assert one(spark, " PMID: 123 ", I.pmid) == "123" and one(spark, "PMC123", I.pmid) is None and one(spark, "0123", I.pmid) is None
    assert one(spark, "pmc77", I.pmcid) == "PMC77" and one(spark, "77", I.pmcid) is None
    assert one(spark, "https://arxiv.org/pdf/2010.11929v2.pdf", I.arxiv) == "2010.11929"
    assert one(spark, "arXiv: HEP-th/9901001v3", I.arxiv) == "hep-th/9901001"
    assert one(spark, "https://example.invalid/abs/2010.11929", I.arxiv) is None
    assert one(spark, "PMID 5, 6；5 7", I.batch) == ["5", "6", "5", "7"]
    assert one(spark, "PMID5", I.link) == "https://pubmed.ncbi.nlm.nih.gov/5/"
    assert one(spark, " Ä ", I.slug).startswith("topic-")


def test_cells(spark):
    assert one(spark, "=1+1", X.safe_csv) == "'=1+1" and one(spark, "abc", X.safe_csv) == "abc" and one(spark, None, X.safe_csv) is None
    assert one(spark, "<a & 'b'>", X.html_escaped) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, "<p>One <b>two</b></p><script>x</script><ul><li>three", X.html_text) == "One two\nthree"


def test_sql(spark):
    from lexifold.functions.sql import register

    register(spark)
    assert spark.sql("SELECT porter_stem('cats') AS a, porter_stems(array('cats', 'ponies')) AS b, porter_stem(NULL) AS c").first() == ("cat", ["cat", "poni"], None)
