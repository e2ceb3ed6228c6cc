import pytest

from lexifold.llm import markup as M
from lexifold.llm import tree
from lexifold.llm.labelled import BLOCKS


def elements(text):
    return M.read(text)[2]


@pytest.mark.parametrize("label, text", BLOCKS)
def test_labelled(label, text):
    assert (M.family(text) or "plain") == label or label in ("latex", "markdown") and "$" in text


@pytest.mark.parametrize(
    "text",
    ["p < 0.05 and A>G with n<47", "Costs of $5 to $9.", "On C:\\runs\\thing the flag #87 marks A | B pairs [31].", "2 * 53 * 49 cells used run_id_86", "carriers of ABC-16*2 and DEF26*3", "", "  ", None],
)
def test_untouched(text):
    assert M.read(text) == (None, text, [])


def test_tags():
    text = '<h2>Data &amp; <i>me</i>thods</h2><p>It ro&shy;se<br/>twice.</p><ul><li>one<li>two <b>x</b></ul><pre><code>if a &lt; b:\n    c</code></pre><span class="math">\\(a_1\\)</span> <script type="math/tex">b</script><!-- rev -->'
    family, clean, found = M.read(text)
    assert family == "tags"
    assert found == [("heading", "Data & methods"), ("list_item", "one"), ("list_item", "two x"), ("code_block", "if a < b:\n    c"), ("formula", "a_1"), ("formula", "b")]
    assert "It rose twice." in clean and "rev" not in clean and "# Data & methods" in clean


def test_jats():
    text = "<sec><title>Main</title><p>Mean<xref>3</xref> fell.</p><list><list-item><p>ten</p></list-item></list><disp-formula><tex-math>x</tex-math></disp-formula><preformat>a &gt; b</preformat></sec>"
    assert elements(text) == [("heading", "Main"), ("list_item", "ten"), ("formula", "x"), ("code_block", "a > b")]


def test_latex():
    text = "\\subsection*{Limits \\emph{and} 5\\%}\n\nIt {\\bf rose}.~\\cite{a} Then \\[x^2\\] and \\(y\\).\n\\begin{itemize}\n\\item one \\textbf{two}\n\\item three\n\\end{itemize}\n\\begin{verbatim}\n  if $a$:\n\\end{verbatim}\n\\begin{equation*}E = 1\\end{equation*}"
    assert elements(text) == [("heading", "Limits and 5%"), ("formula", "x^2"), ("formula", "y"), ("list_item", "one two"), ("list_item", "three"), ("code_block", "if $a$:"), ("formula", "E = 1")]
    assert "It rose. Then" in M.read(text)[1]


def test_wiki():
    text = "== Methods [[a|for]] b ==\n\nIt '''rose'''.{{cn}}<ref>n</ref>\n\n* one ''two''\n** three\n# four\n\n<syntaxhighlight lang=\"r\">\nx <- 1\n</syntaxhighlight>\n<math>\\hat{y}</math>"
    assert elements(text) == [("heading", "Methods for b"), ("list_item", "one two"), ("list_item", "three"), ("list_item", "four"), ("code_block", "x <- 1"), ("formula", "\\hat{y}")]
    assert "It rose." in M.read(text)[1]


def test_markdown():
    text = "Data `and` more\n-----\n\nIt **rose**.[^2] See [it](https://x.invalid/a).\n\n## Next ##\n\n1. one\n2. two *x*\n\n```python\nif a:\n    b\n```\n\nWith $x_1$ and $$y = 2$$ at $5 to $9."
    assert elements(text) == [("heading", "Data and more"), ("heading", "Next"), ("list_item", "one"), ("list_item", "two x"), ("code_block", "if a:\n    b"), ("formula", "x_1"), ("formula", "y = 2")]
    assert "It rose. See it." in M.read(text)[1] and "$5 to $9" in M.read(text)[1]


def test_held_out():
    """Fields put together from other words than the table's."""
    fields = {
        "tags": "Few <em class='k'>plants</em> grew.<sup></sup> The rain came.",
        "latex": "Few \\textit{plants} grew by 3\\% in rain.",
        "wiki": "Few '''plants''' grew in [[rain]].",
        "markdown": "Few **plants** grew in [rain](https://r.invalid/x).",
    }
    for label, text in fields.items():
        assert M.family(text) == label
        assert M.family(text + "\n\n" + "Dry words follow the rain. " * 30) == label


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>A</p>\\section{Data}\n\nIt \\emph{x} rose.", [("heading", "Data")]),
        ("<p>Few plants grew.</p>\n\n\\section{Data \\emph{x}}\n\nIt rose.", [("heading", "Data x")]),
        ("<p>Few plants grew.</p>\n\n## Heading\n\n- item\n- other **item**", [("heading", "Heading"), ("list_item", "item"), ("list_item", "other item")]),
        ("2. a\n3. b", [("list_item", "a"), ("list_item", "b")]),
        ("7. one plant\n8. two plants\n9. three plants", [("list_item", "one plant"), ("list_item", "two plants"), ("list_item", "three plants")]),
        ("== Rain ==\n\n# [[one]]\n# two\n\n<pre>\na = [1]\n\n## b\n</pre>", [("heading", "Rain"), ("list_item", "one"), ("list_item", "two"), ("code_block", "a = [1]\n\n## b")]),
        ("Few **plants** grew.\n\n```\n\\section{a}\n\n<p>b</p>\n```", [("code_block", "\\section{a}\n\n<p>b</p>")]),
    ],
)
def test_blocks_of_several_families(text, want):
    found, clean, elements_ = M.read(text)
    assert found and elements_ == want
    assert "emph" not in clean and "**" not in clean


def test_tree_splits_on_words_and_link_density():
    """Fitted without a third of the labelled fields, it tells their blocks; words and densities are all it has."""
    used = set()

    def walk(node):
        if not isinstance(node, str):
            used.add(node[0])
            walk(node[2]), walk(node[3])

    right = n = 0
    for part in (1, 2, 3):
        fitted = tree.fit(*M.labelled_rows(part)[:2], depth=12)
        walk(fitted)
        rows, labels, _ = M.labelled_rows(-part)
        right += sum(tree.classify(fitted, r) == y for r, y in zip(rows, labels))
        n += len(rows)
    names = {M.FEATURES[k % len(M.FEATURES)] for k in used if k < 3 * len(M.FEATURES)}
    assert {"words", "link density"} & names and any("density" in x for x in names)
    assert right > 0.9 * n


def test_table(spark):
    rows = [(1, "<b>x</b>", None, "c"), (1, "<b>x</b>", None, "c"), (2, None, "", "c"), (3, "<p>" + "long words " * 40_000 + "</p><h1>End</h1>", "plain", "c")]
    df = spark.createDataFrame(rows, "k bigint, a string, b string, elements string")
    got = M.clean_fields(df, "k", ["a", "b"])
    assert sorted((r.k, r.part, r.family, len(r.elements)) for r in got.collect() if r.family) == [(1, "a", "tags", 0), (1, "a", "tags", 0), (3, "a", "tags", 1)]
    assert got.filter("k = 2").first().clean_text == ""
    assert M.clean_fields(df.limit(0), "k", ["a", "b"]).count() == 0


def test_tree():
    rows, labels = [(0, 0), (0, 1), (1, 0), (1, 1)], ["a", "b", "b", "a"]
    fitted = tree.fit(rows, labels)
    assert [tree.classify(fitted, r) for r in rows] == labels or tree.fit(rows, labels, 0) in "ab"
