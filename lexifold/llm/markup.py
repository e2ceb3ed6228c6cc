"""Markup residue to clean text that keeps headings, lists, code and formulas.

A field is cut into flat text blocks; code stays in one block.  Each block is
described by its word count and its link density, and by both of its neighbours.
Link density is the share of a block's words that links and other marks take in, of
all families together and of each markup family (the marks of a formula or a list
item, which several families share, apart).  A decision tree trained on the labelled
table in ``labelled.py`` says which family's markup a block holds, or that it only
looks like markup.  A field's family is the one with most marks; a block with marks
of its own family only that the field's family doesn't know is read as what it is.
Runs of blocks of one family go to that family's reader.  A field without a marked
block stays untouched.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexifold.llm import tree
from lexifold.llm.labelled import BLOCKS, PADDING

# Element names of HTML, JATS and wiki text.
NAMES = (
    "a abbr abstract article b big blockquote body bold br caption center cite code dd del disp-formula disp-quote div dl dt em "
    "ext-link fig figure font h1 h2 h3 h4 h5 h6 head header hr html i img inline-formula ins italic kbd label li link list list-item "
    "main mark math monospace named-content nav ol p pre preformat q s samp sc script sec section small source span strike strong "
    "style styled-content sub sup table tbody td tex-math th thead title tr tt u ul underline var xref"
)
WIKI_NAMES = "gallery math nowiki ref references source syntaxhighlight"

TAG = re.compile(r"</?(" + "|".join(sorted(NAMES.split() + WIKI_NAMES.split(), key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!\[CDATA\[|\]\]>|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
COMMAND = re.compile(
    r"\\[A-Za-z]+\*?(?=[\[{])|(?<![\w:\\])\\[A-Za-z]+|(?<!\\)\\[%&_#$(){}\[\]]|(?<=[.!?;,)\]])\\[A-Za-z]+|\{\\[a-z]{2,}\s"
)
MATH = re.compile(r"(?<![\w\\$])\$(?![\s$])([^$\n]*?[^$\s\\])\$(?![\w$])")
MATHLIKE = re.compile(r"[\\^_={}]|^[A-Za-z]$")
WIKI = re.compile(r"'''?(?=\S)|\[\[[^\]\n]+\]\]|\{\{[^{}\n]*\}\}|^(={1,6})[^=\n].*\1\s*$|</?(?:ref|syntaxhighlight|nowiki|gallery)\b[^<>]*>|<math(?: display=\"\w+\")?>", re.M)
MARKDOWN = re.compile(
    r"\[[^\]\n]*\]\([^)\s]+(?:\s\"[^\"]*\")?\)|\[\^[^\]\s]+\]|(?<![\w*])\*\*(?=\S)[^*\n]+\*\*(?!\w)|(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])"
    r"|(?<!\w)__(?=\S)[^_\n]+__(?!\w)|(?<!\w)_(?=[^\s_])[^_\n]*[^\s_]_(?!\w)|(?<!`)`[^`\n]+`(?!`)|^(?:```|~~~)|^#{1,6}\s+\S"
    r"|^[^\s].*\n(?:={3,}|-{3,})[ \t]*$|~~\S[^~\n]*~~",
    re.M,
)
ITEM = re.compile(r"^[ \t]*(?:[*+\-]|\d{1,3}[.)])[ \t]+\S|^[*#:;]+[ \t]*\S", re.M)
LINK = re.compile(r"<a\b[^<>]*>(.*?)</a>|\[([^\]\n]+)\]\([^)\s]+\)|\[\[(?:[^\]|\n]*\|)?([^\]\n]+)\]\]|(https?://\S+)", re.S | re.I)
EDGE = re.compile(r"\n[ \t]*\n|(?<=</p>)|(?<=</div>)", re.I)

FAMILIES = ("tags", "latex", "wiki", "markdown")
MARKS = {"tags": (0, 2), "latex": (3,), "wiki": (1, 5), "markdown": (6,)}  # of ``counts``, each family's own
#: Marks that no other family's text holds.
OWN = {
    "tags": re.compile(r"</?(?:p|div|h[1-6]|ul|ol|li|b|i|em|strong|a|sec|title|list|list-item|italic|bold|xref|table|td|tr|span)\b[^<>]*>", re.I),
    "latex": re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    "wiki": re.compile(r"'{2,3}\S|\[\[[^\]\n]+\]\]|\{\{[^{}\n]*\}\}|^(={2,6})[^=\n]+\1\s*$|<ref\b", re.M),
    "markdown": re.compile(r"\[[^\]\n]+\]\(\w+:[^)\s]+\)|(?<![\w*])\*\*(?=\S)[^*\n]+\*\*(?!\w)|^(?:```|~~~)|^#{2,6} +\S", re.M),
}
CODE = re.compile(
    r"^(?P<fence>```+|~~~+)[^\n]*\n.*?(?:^(?P=fence)|\Z)|<(?P<tag>pre|preformat|syntaxhighlight|source)\b[^<>]*>.*?</(?P=tag)\s*>|\\begin\{(?P<env>verbatim|lstlisting|minted|alltt)\*?\}.*?\\end\{(?P=env)",
    re.M | re.S | re.I,
)


def counts(block: str) -> tuple[int, ...]:
    """Marks of a block: tags, wiki tags, entities, commands, formulas, wiki marks, Markdown marks, items."""
    tags = wiki_tags = entities = commands = formulas = wiki = markdown = 0
    if "<" in block:
        for m in TAG.finditer(block):
            if m.group(1).lower() in ("ref", "syntaxhighlight", "nowiki", "math") and "/math" not in m.group():
                wiki_tags += 1
            else:
                tags += m.group(1).lower() != "math"
        tags += len(COMMENT.findall(block))
    if "&" in block:
        entities = sum(html.unescape(m) != m for m in ENTITY.findall(block))
    if "\\" in block:
        commands = len(COMMAND.findall(MATH.sub("", block) if "$" in block else block))  # any family can hold formulas
    if "$" in block:
        formulas = sum(bool(MATHLIKE.search(m)) for m in MATH.findall(block)) + block.count("$$") // 2
    if "'" in block or "[" in block or "{" in block or "=" in block:
        wiki = sum(1 for _ in WIKI.finditer(block))
    if any(c in block for c in "*_`[#~=-"):
        markdown = sum(1 for _ in MARKDOWN.finditer(block))
    return tags, wiki_tags, entities, commands, formulas, wiki, markdown, len(ITEM.findall(block))


#: A block's features; the same of the block before and of the one behind follow, and the field's.
FEATURES = ("words", "link density", *(f"{f} density" for f in FAMILIES), "formula density", "item density")


def described(block: str) -> tuple[tuple[float, ...], tuple[int, ...]]:
    """A block's features and marks."""
    words = len(block.split())
    linked = sum(len(next(g for g in m.groups() if g is not None).split()) for m in LINK.finditer(block)) if "[" in block or "<a" in block or "<A" in block or "://" in block else 0
    marks = counts(block)
    of = lambda n: min(1.0, n / words) if words else 0.0
    families = [sum(marks[k] for k in MARKS[f]) for f in FAMILIES]
    return (float(words), of(linked + sum(families) + marks[4] + marks[7]), *map(of, families), of(marks[4]), of(marks[7])), marks


def features(blocks: list[str]) -> tuple[list[tuple[float, ...]], list[tuple[int, ...]]]:
    """Of each block: its features, its neighbours', the field's densities by family; and its marks."""
    own, marks = [list(x) for x in zip(*map(described, blocks))] if blocks else ([], [])
    nothing = (0.0,) * len(FEATURES)
    words = sum(o[0] for o in own) or 1.0
    whole = tuple(min(1.0, sum(sum(m[k] for k in MARKS[f]) for m in marks) / words) for f in FAMILIES)
    return [(*o, *(own[i - 1] if i else nothing), *(own[i + 1] if i + 1 < len(own) else nothing), *whole) for i, o in enumerate(own)], marks


def blocks_of(text: str) -> list[str]:
    """Blocks between blank lines and closed paragraphs, with the blanks that follow them; code isn't cut."""
    kept = [m.span() for m in CODE.finditer(text)] if any(c in text for c in "`~<\\") else []
    cuts = [m.end() for m in EDGE.finditer(text) if not any(a < m.end() < b for a, b in kept)]
    out: list[str] = []
    for first, end in zip([0, *cuts], [*cuts, len(text)]):
        piece = text[first:end]
        if out and not piece.strip():
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


@cache
def labelled_rows(which: int | None = None, of: int = 3) -> tuple[list, list, list]:
    """Features, labels and fields' numbers of the labelled table's blocks: all, or without (with, if negative) every ``of``-th field."""
    rows, labels, numbers = [], [], []
    for number, (label, field) in enumerate(BLOCKS):
        if which is not None and (number % of == abs(which) - 1) != (which < 0):
            continue
        for pad in PADDING:
            for padded in {f"{pad} {field}" if pad else field, f"{pad}\n\n{field} {pad}".strip()}:
                found, marks = features(blocks_of(padded))
                for row, own in zip(found, marks):
                    rows.append(row)
                    labels.append(label if any(own) else "plain")
                    numbers.append(number)
    return rows, labels, numbers


@cache
def classifier():
    return tree.fit(*labelled_rows()[:2], depth=12)


def families(blocks: list[str]) -> list[str | None]:
    """Each block's family; all None if nothing in the field is markup."""
    rows, marks = features(blocks)
    voted = [tree.classify(classifier(), row) for row in rows]
    found = set(voted) - {"plain"}
    if not found:
        return [None] * len(blocks)
    own = [{f: sum(m[k] for k in MARKS[f]) for f in FAMILIES} for m in marks]
    base = max((f for f in FAMILIES if f in found), key=lambda f: sum(o[f] for o in own))
    if len(found) == 1:
        return [base] * len(blocks)
    return [v if v not in ("plain", base) and OWN[v].search(b) and not OWN[base].search(b) else base for v, b in zip(voted, blocks)]


def family(text: str) -> str | None:
    """The markup family of a field; None if nothing in it is markup."""
    if text.isspace():
        return None
    found = [f for f in families(blocks_of(text)) if f]
    return Counter(found).most_common(1)[0][0] if found else None


# --- readers -----------------------------------------------------------------
# A reader marks what it finds inside the text: \x01 kind ... \x02 around headings
# and items, \x01 kind number \x02 for code and formulas kept aside.


class Kept:
    """Code and formulas taken out of the text while the rest is cleaned."""

    def __init__(self) -> None:
        self.held: list[str] = []

    def put(self, kind: str, source: str) -> str:
        self.held.append(source.strip())
        return f"\x01{kind}{len(self.held) - 1}\x02"


def _close(text: str, at: int) -> int:
    """End of the brace group that opens at ``at``; the line's end if it doesn't close."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{" and text[i - 1] != "\\":
            depth += 1
        elif text[i] == "}" and text[i - 1] != "\\":
            depth -= 1
            if not depth:
                return i
    return text.find("\n", at) if "\n" in text[at:] else len(text)


def _unescaped(text: str) -> str:
    return html.unescape(text).replace("\xa0", " ").replace("\xad", "")


def plain_tags(text: str) -> str:
    """Words of tagged text."""
    text = COMMENT.sub("", text)
    text = TAG.sub(lambda m: " " if m.group(1).lower() in ("br", "p", "div", "td", "th", "tr") else "", text)
    text = _unescaped(text)
    return TAG.sub("", text) if "<" in text else text


def plain_latex(text: str) -> str:
    """Words of LaTeX."""
    text = re.sub(r"(?<!\\)%.*", "", text)
    text = re.sub(r"\\(?:no)?cite[a-z]*\*?(?:\[[^\]]*\])*\{[^{}]*\}|\\(?:label|ref|eqref|pageref|index|vspace|hspace|input|bibliography|bibliographystyle|usepackage|documentclass)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", "", text)
    before = None
    while before != text:  # from the innermost group outwards
        before = text
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{((?:[^{}\\]|\\.)*)\}", r"\1", text)
        text = re.sub(r"(?<!\\)\{\s*\\[A-Za-z]+\s+((?:[^{}\\]|\\.)*)\}", r"\1", text)
        text = re.sub(r"(?<!\\)\{((?:[^{}\\]|\\.)*)\}", r"\1", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"(?<![\w:\\])\\[A-Za-z]+\*?[ \t]*", " ", text)  # not in C:\\paths
    text = re.sub(r"(?<!\\)~", " ", text).replace("---", "—").replace("``", '"').replace("''", '"')
    return re.sub(r"\\([%&_#$(){}\[\]~])", r"\1", text)


def plain_wiki(text: str) -> str:
    """Words of wiki text."""
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", text, flags=re.S | re.I)
    before = None
    while before != text:
        before = text
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\s+([^\]\n]+)\]", r"\1", text)
    return plain_tags(re.sub(r"'{2,5}", "", text))


def plain_markdown(text: str) -> str:
    """Words of Markdown."""
    text = re.sub(r"\[\^[^\]\s]+\]:?", "", text)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\s]*(?:\s\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        text = re.sub(rf"(?<![\w*\\]){mark}(?=[^\s*])([^*\n]*?[^\s*\\]){mark}(?![\w*])|(?<![*\\]){mark}(?=[^\s*])([^*\n\d]*?[^\s*\\]){mark}(?!\*)", lambda m: m.group(1) or m.group(2), text)
    for mark in ("__", "_"):
        text = re.sub(rf"(?<![\w\\]){mark}(?=[^\s_])([^\n]*?[^\s_\\]){mark}(?!\w)", r"\1", text)
    text = re.sub(r"~~(\S[^~\n]*)~~", r"\1", text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!$~|<>&%])", r"\1", text)
    return plain_tags(text) if "<" in text or "&" in text else text


PLAIN = {"tags": plain_tags, "latex": plain_latex, "wiki": plain_wiki, "markdown": plain_markdown}


def _dollars(text: str, kept: Kept) -> str:
    text = re.sub(r"\$\$(.+?)\$\$", lambda m: kept.put("f", m.group(1)), text, flags=re.S)
    return MATH.sub(lambda m: kept.put("f", m.group(1)) if MATHLIKE.search(m.group(1)) else m.group(), text)


def read_tags(text: str, kept: Kept) -> str:
    def kept_aside(m: re.Match) -> str:
        name, inner = m.group(1).lower(), m.group(2)
        if name in ("pre", "preformat"):
            return "\n" + kept.put("c", _code(TAG.sub("", COMMENT.sub("", inner)))) + "\n"
        if name == "span":
            inner = re.sub(r"^\s*(?:\\\(|\\\[|\$\$?)|(?:\\\)|\\\]|\$\$?)\s*$", "", inner)
        return kept.put("f", inner if name == "script" else _unescaped(inner))

    text = re.sub(
        r"<(pre|preformat)\b[^<>]*>(.*?)</\1\s*>|<(script)\b[^<>]*type=[\"']?math/tex[^<>]*>(.*?)</script\s*>|<(span)\b[^<>]*class=[\"']?math\b[^<>]*>(.*?)</span\s*>"
        r"|<(tex-math|math)\b[^<>]*>(.*?)</\7\s*>",
        lambda m: kept_aside(_Pair(next((m.group(k), m.group(k + 1)) for k in (1, 3, 5, 7) if m.group(k)))),
        text,
        flags=re.S | re.I,
    )
    text = re.sub(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", lambda m: kept.put("f", _unescaped(m.group(1) or m.group(2))), text, flags=re.S)
    text = re.sub(r"<(script|style|head)\b[^<>]*>.*?</\1\s*>", "", text, flags=re.S | re.I)
    out, at, mode = [], 0, ""
    for m in TAG.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        name, closing = m.group(1).lower(), m.group().startswith("</")
        if re.fullmatch(r"h[1-6]|title|caption", name) and name != "caption":
            if mode:
                out.append("\x02")
            mode = "" if closing else "h"
            out.append("\n" if closing else "\n\x01h")
        elif name in ("li", "list-item"):
            if mode:
                out.append("\x02")
            mode = "" if closing else "l"
            out.append("\n" if closing else "\n\x01l")
        elif name in ("ul", "ol", "list") or (name in ("div", "sec", "section", "table") or name == "p" and mode == "h"):
            if mode:
                out.append("\x02")
                mode = ""
            out.append("\n")
        else:
            out.append("\n" if name == "p" and not mode else m.group())
    out.append(text[at:])
    if mode:
        out.append("\x02")
    return "".join(out)


class _Pair:
    """Two groups under a match's interface."""

    def __init__(self, pair: tuple[str, str]) -> None:
        self.pair = pair

    def group(self, k: int) -> str:
        return self.pair[k - 1]


def _code(text: str) -> str:
    return html.unescape(text).replace("\xa0", " ")


def read_latex(text: str, kept: Kept) -> str:
    text = re.sub(
        r"\\begin\{(verbatim|lstlisting|minted|alltt|Verbatim)\*?\}(?:\[[^\]\n]*\])?(?:(?<=minted\})\{[^}]*\})?(.*?)\\end\{\1\*?\}",
        lambda m: "\n" + kept.put("c", m.group(2)) + "\n",
        text,
        flags=re.S,
    )
    text = re.sub(
        r"\\begin\{(equation|align|gather|displaymath|math|eqnarray|multline)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.+?)\\\]|\\\((.+?)\\\)",
        lambda m: kept.put("f", re.sub(r"\\label\{[^}]*\}", "", m.group(3) or m.group(4) or m.group(5))),
        text,
        flags=re.S,
    )
    text = _dollars(text, kept)
    out, at = [], 0
    for m in re.finditer(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\]\n]*\])?(?=\{)", text):
        if m.start() < at:
            continue
        end = _close(text, m.end())
        out += [text[at : m.start()], "\n\x01h", text[m.end() + 1 : end], "\x02\n"]
        at = end + 1
    text = "".join(out) + text[at:]
    return re.sub(r"\\item\b(?:\[[^\]\n]*\])?(.*?)(?=\\item\b|\\end\{|\\begin\{|\n[ \t]*\n|\x01h|\Z)", lambda m: f"\n\x01l{m.group(1)}\x02\n", text, flags=re.S)


def read_wiki(text: str, kept: Kept) -> str:
    text = re.sub(r"<(syntaxhighlight|source|pre)\b[^<>]*>(.*?)</\1\s*>", lambda m: "\n" + kept.put("c", _code(m.group(2)) if m.group(1).lower() == "pre" else m.group(2)) + "\n", text, flags=re.S | re.I)
    text = re.sub(r"<math\b[^<>]*>(.*?)</math\s*>", lambda m: kept.put("f", _unescaped(m.group(1))), text, flags=re.S | re.I)
    text = re.sub(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", "\x01h\\2\x02", text, flags=re.M)
    return re.sub(r"^[*#:;]+[ \t]*(\S.*)$", "\x01l\\1\x02", text, flags=re.M)


def read_markdown(text: str, kept: Kept) -> str:
    text = re.sub(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:\n[ \t]*\1[`~]*[ \t]*$|^[ \t]*\1[`~]*[ \t]*$|\Z)", lambda m: kept.put("c", m.group(2)) + "\n", text, flags=re.S | re.M)
    text = _dollars(text, kept)
    text = re.sub(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", lambda m: kept.put("f", m.group(1) or m.group(2)), text)
    text = re.sub(r"^[ ]{0,3}#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*$", "\x01h\\1\x02", text, flags=re.M)
    text = re.sub(r"^(?![ \t]*(?:[-*+]|\d+[.)])[ \t])[ ]{0,3}(\S[^\n\x01]*)\n(?:=+|-{2,})[ \t]*$", "\x01h\\1\x02", text, flags=re.M)
    return re.sub(r"^[ \t]*(?:[*+\-]|\d{1,9}[.)])[ \t]+(\S.*)$", "\x01l\\1\x02", text, flags=re.M)


READERS = {"tags": read_tags, "latex": read_latex, "wiki": read_wiki, "markdown": read_markdown}
MARKED = re.compile(r"\x01([hlcf])(?:(\d+)\x02|((?:[^\x01\x02]|\x01[cf]\d+\x02)*)\x02)")
ASIDE = re.compile(r"\x01[cf](\d+)\x02")
ELEMENTS = {"h": "heading", "l": "list_item", "c": "code_block", "f": "formula"}


def read(text: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """Family, clean text and elements (kind, clean text) of a field in reading order; a field without markup is returned as it is."""
    if not text or text.isspace():
        return None, text, []
    text_ = text.replace("\r\n", "\n")
    blocks = blocks_of(text_)
    voted = families(blocks)
    if not any(voted):
        return None, text, []
    runs: list[list] = []
    for f, block in zip(voted, blocks):
        if runs and runs[-1][0] == f:
            runs[-1][1] += block
        else:
            runs.append([f, block])
    cleaned, elements = zip(*(_read_as(f, piece) for f, piece in runs))
    return Counter(voted).most_common(1)[0][0], re.sub(r"\n{3,}", "\n\n", "\n\n".join(c for c in cleaned if c)), [e for es in elements for e in es]


def _read_as(found: str, text: str) -> tuple[str, list[tuple[str, str]]]:
    """Clean text and elements of a text of one family."""
    kept, elements = Kept(), []
    marked = READERS[found](text.replace("\x01", "").replace("\x02", ""), kept)

    def words(inner: str) -> str:
        return " ".join(ASIDE.sub(lambda m: kept.held[int(m.group(1))], PLAIN[found](inner)).split())

    out, at = [], 0
    for m in MARKED.finditer(marked):
        out.append(_lines(PLAIN[found](marked[at : m.start()])))
        at = m.end()
        kind = m.group(1)
        if m.group(2):
            source = kept.held[int(m.group(2))]
            elements.append((ELEMENTS[kind], source))
            out.append(f"\n```\n{source}\n```\n" if kind == "c" else f"${source}$")
            continue
        inner = words(m.group(3))
        if inner:
            elements.append((ELEMENTS[kind], inner))
            out.append(f"\n# {inner}\n" if kind == "h" else f"\n- {inner}\n")
        for x in ASIDE.finditer(m.group(3)):
            elements.append((ELEMENTS[x.group()[1]], kept.held[int(x.group(1))]))
    out.append(_lines(PLAIN[found](marked[at:])))
    clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out)))
    return clean.replace("\x01", "").replace("\x02", "").strip(), elements


def _lines(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text)


FIELDS = "part string, family string, clean_text string, elements array<struct<elem: string, elem_no: bigint, clean_text: string>>"


def clean_fields(texts: DataFrame, key: str, columns: list[str], rows: int = 1000) -> DataFrame:
    """One row per field that isn't null: key, part, family, clean_text, elements.

    ``family`` is null and ``clean_text`` the field itself where it holds no markup,
    which goes for empty and blank fields too.  ``elem_no`` counts each kind from 1.
    Repeated rows come out each, other columns are ignored, an empty table gives an
    empty result.
    """
    element = pa.struct([("elem", pa.string()), ("elem_no", pa.int64()), ("clean_text", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                out: list[list] = [[], [], [], [], []]
                for identity, *fields in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
                    for part, text in zip(columns, fields):
                        if text is None:
                            continue
                        found, clean, elements = read(text)
                        seen: Counter = Counter()
                        numbered = []
                        for kind, inner in elements:
                            seen[kind] += 1
                            numbered.append({"elem": kind, "elem_no": seen[kind], "clean_text": inner})
                        for column, value in zip(out, (identity, part, found, clean, numbered)):
                            column.append(value)
                kinds = (batch.column(key).type, pa.string(), pa.string(), pa.string(), pa.list_(element))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names=[key, "part", "family", "clean_text", "elements"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, *columns).mapInArrow(task, f"`{key}` {kind}, {FIELDS}")
