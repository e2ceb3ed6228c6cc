"""The labelled table of the markup classifier: families and fields written for it.

A field's blocks that hold marks carry the field's label; the others are plain.
Fields labelled plain hold marks' characters that aren't markup.
"""

BLOCKS: tuple[tuple[str, str], ...] = (
    ("plain", "The trial enrolled 40 patients, and outcomes were stable after 12 weeks."),
    ("plain", "Values such as p < 0.05 and x > 3.1 were rare; A>G with n<40 was seen in carriers of ABC-2*3 and DEF4*5."),
    ("plain", "Costs of $5 to $9 per unit were low, and $12 was the most anyone paid."),
    ("plain", "On C:\\data\\raw the flag #87 marks A | B pairs [31]."),
    ("plain", "The grid of 2 * 53 * 49 cells used run_id_86 and max_token_len."),
    ("plain", "Files are kept at https://data.example.invalid/v1.2/index.html for reuse."),
    ("plain", "RESULTS: Outcomes were (i) rain; (ii) snow; and (iii) hail.\nMETHODS: We mapped 30 regions [4,5].\n\nCONCLUSIONS: It's the patient's choice."),
    ("plain", "Her method isn't new. R&D costs rose; AT&T took part.\n\nThe ratio was 3:1 at 5 - 7 weeks."),
    ("plain", "Limits\nThe model of ten sites was wrong.\n\nOutlook\nWe plan more."),
    ("plain", "The tag {a, b} is a set, f(x) = 3 a function, and ~5 % a guess."),
    ("plain", "2. Phase begann im Mai.\n\nDie 3. Gruppe blieb. 4. Juli"),
    ("plain", "It rose to 5\u2032 and 6\u2033 -- see below -- by 2*3 of module_a."),
    ("plain", "Who is at user@example.invalid or path\\to\\file and D:\\new\\text today?"),
    ("tags", "Higher dose <b>preceded</b> relapse by 20 days. The rest held."),
    ("tags", "The main finding.&nbsp; It held."),
    ("tags", "It remained &lt;i&gt;the&lt;/i&gt; driver of change."),
    ("tags", "Our po&shy;licy of care reached 3.0 in 10 sites."),
    ("tags", "<p>We compared two drugs.</p>\n<h2>Methods &amp; data</h2>\n<ul><li>one drug</li><li>two drugs</ul>\n<pre><code>if a &lt; b: stop()</code></pre>"),
    ("tags", "<sec><title>Findings</title><p>Mean <italic>age</italic> was 40.<xref ref-type=\"bibr\">3</xref></p><list list-type=\"bullet\"><list-item><p>ten mice</p></list-item></list></sec>"),
    ("tags", "It fell.<br/> It rose <font size=2>again</font>.<sup></sup>"),
    ("tags", "Here <script type=\"math/tex\">a_{1} = \\frac{b}{c}</script> holds."),
    ("tags", "Here <span class=\"math\">\\(a_{1} = \\frac{b}{c}\\)</span> holds."),
    ("tags", "We found <inline-formula><tex-math>\\hat{y}_{3}</tex-math></inline-formula> there."),
    ("tags", "It stayed low.<!-- rev --> It rose."),
    ("tags", "See <a href=\"https://example.invalid/3\">the site</a> for more words about it."),
    ("tags", "An orphan</i> tag remained in the text."),
    ("latex", "We \\emph{mapped} diet across 5 regions.\\noindent  It rose."),
    ("latex", "Signal fell by 10\\% after a week."),
    ("latex", "The {\\bf ratio} of dose to age was 3."),
    ("latex", "Loss was high.~\\cite{smith} It fell later."),
    ("latex", "It held.\\label{eq:a} It fell."),
    ("latex", "Here \\(\\log\\left(4 + x\\right)\\) holds."),
    ("latex", "\\[\\sqrt{n_{1}} \\ge 3\\]"),
    ("latex", "\\section{Data and methods}\n\nWe trained it.\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\n\\begin{equation}a = b\\end{equation}"),
    ("latex", "\\subsection*{Limits}\n\n\\begin{lstlisting}\nfor k in range(3):\n    print(k)\n\\end{lstlisting}"),
    ("latex", "\\paragraph{Results \\emph{and} more}\n\nCosts of 5\\% \\& more."),
    ("latex", "Here $\\hat{y}_{5} = 3$ holds."),
    ("latex", "Here $E = \\alpha^{3}$ holds.~\\cite{a}"),
    ("latex", "\\textbf{Among} 5 adults, it fell \\textit{again}."),
    ("wiki", "Higher '''dose''' preceded relapse by 20 days. The ''rest'' held."),
    ("wiki", "Few cultures [[drug|reported]] change in [[age]]."),
    ("wiki", "It preceded decline.{{cn}} It rose."),
    ("wiki", "It held.<ref>Note</ref> It fell.<ref name=\"r1\"/>"),
    ("wiki", "Here <math>\\beta_{3} x</math> holds."),
    ("wiki", "Here <math display=\"block\">a = b</math> holds."),
    ("wiki", "== Methods ==\n\nWe trained it.\n\n* one dose\n* two ''doses''\n\n<syntaxhighlight lang=\"r\">\nx <- 3\n</syntaxhighlight>"),
    ("wiki", "= Study setting =\n\n# first dose\n# second dose\n\nIt rose.{{cn}}"),
    ("wiki", "# first [[dose]]\n# second dose\n# third ''dose''\n# fourth dose\n\nIt '''rose''' in [[ten]] sites.{{cn}}\n\n# one more [[dose|of it]]\n# another"),
    ("wiki", "===Limits===\n\n** deep item one\n** deep item two\n\n<pre>\nwhile (i < 3) { i += 1; }\n</pre>\n\nWe saw <math>\\hat{y}</math>."),
    ("markdown", "It **rose** in 3 sites. It fell."),
    ("markdown", "Interest in [age](https://example.invalid/a) has grown.[^2] It fell."),
    ("markdown", "The rate was low.[^6]"),
    ("markdown", "__The__ ratio was 3. It fell."),
    ("markdown", "It was *for* the best of 2 sites."),
    ("markdown", "We saw `change` in 4 sites."),
    ("markdown", "## Methods\n\nWe trained it with $\\hat{y}_{2}$.\n\n- one dose\n- two doses\n\n```python\nprint(3)\n```"),
    ("markdown", "Outlook and more\n----------------\n\nIt rose.\n\n1. one dose\n2. two doses\n\n~~~\nSELECT a\nFROM b\n~~~"),
    ("markdown", "Limits `for` drugs\n========\n\n* one [dose](https://example.invalid/b)\n* two doses\n\n$$a = \\frac{b}{c}$$"),
    ("markdown", "# Data ##\n\n+ one\n+ two **doses**"),
    ("markdown", "- one dose of drug\n- two doses of drug\n- three doses of drug"),
    ("markdown", "1. one dose of drug\n2. two doses of drug\n3. three doses of drug"),
    ("markdown", "2. one dose of drug\n3. two doses of drug"),
    ("markdown", "7) one dose\n8) two doses\n9) three doses"),
    ("markdown", "10. sites in the north\n11. sites in the south"),
    ("markdown", "* mice\n* rats"),
    ("plain", "The second group began on 3. May.\n\n4. June was the last day of the trial."),
    ("plain", "Doses of 2.\n5 mg were given - and kept - for 3 weeks."),
    ("plain", "One of the groups (n = 5) had p > 0.1; the range [3, 7] was {wide}."),
    ("plain", "Weights rose by 3 * 4 g and by 5 * 6 g; see run_id, max_len and min_len."),
    ("plain", "In the year of the trial many of the patients who had been seen by the team of nurses came back to the ward, and the committee of the hospital saw no reason to end it."),
    ("tags", "In the year of the trial many of the patients who had been seen by the <i>team</i> of nurses came back to the ward, and the committee of the hospital saw no reason to end it."),
    ("tags", "<div>One of ten mice.</div><div>Two of ten rats.</div>"),
    ("tags", "<table><tr><td>ten</td><td>mice</td></tr></table>"),
    ("tags", "AT&amp;T took part, and R&amp;D costs rose."),
    ("latex", "In the year of the trial many of the patients who had been seen by the \\textbf{team} of nurses came back to the ward, and the committee of the hospital saw no reason to end it."),
    ("latex", "\\begin{enumerate}\n\\item mice\n\\item rats\n\\end{enumerate}"),
    ("latex", "\\chapter{Setting}\n\nWe saw it in \\textsc{ten} sites."),
    ("latex", "\\section{Data}\n\nIt rose."),
    ("wiki", "In the year of the trial many of the patients who had been seen by the [[team]] of nurses came back to the ward, and the committee of the hospital saw no reason to end it."),
    ("wiki", "== Data and more ==\n\nIt rose."),
    ("wiki", "* [[mice]]\n* [[rats|the rats]]\n** [[old rats]]"),
    ("markdown", "In the year of the trial many of the patients who had been seen by the **team** of nurses came back to the ward, and the committee of the hospital saw no reason to end it."),
    ("markdown", "### Data and more\n\nIt rose."),
    ("markdown", "## Heading\n\n- item of the list"),
    ("markdown", "See [the site](https://example.invalid/x \"title\") and ![figure](https://example.invalid/y.png)."),
)

#: Plain sentences put around each labelled field, so that length says nothing about its label.
PADDING = (
    "",
    "The rest of the sites kept the old plan, and the committee of the second trial saw no reason to change it before the end of the year.",
    "It ended. The ratio of dose to age was 3.1 at baseline, and few of the 40 patients who left early had been seen more than once by the same team of nurses.",
)
#: And a long text, in which one mark is hardly any of the words.
PADDING += (" ".join([PADDING[1], PADDING[2]] * 8),)
