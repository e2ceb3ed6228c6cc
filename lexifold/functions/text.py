"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 71 English stop words.
STOP_WORDS = (
    "a about also an and are as at be been being but by can could did do does for from had has have he her his how if in into is it its may might "
    "no not of on or our she should such than that the their then these they this those to use used using was we were what when where which who "
    "whom will with would you your"
).split()
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("approx", "Dr", r"e\.g", "Eq", "Eqs", r"et\s+al", "Fig", "Figs", r"i\.e", "Mr", "Mrs", "Ms", "No", "Prof", "vol", "vs")

TOKEN = r"\p{Nd}+(?:\.\p{Nd}+)+|[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
#: White space as Unicode has it, for both Java's and RE2's classes.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
KEPT, CUT = "", ""  # a dot that ends nothing; a sentence's end


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case with ß written ss."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def strip(c: Column | str) -> Column:
    """Without white space at either edge."""
    return F.regexp_replace(_col(c), f"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column | str) -> Column:
    """Folded tokens in order: decimals whole, else letters and digits joined by single apostrophes or hyphens."""
    found = F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0))
    return F.transform(found, fold)


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def basic_tokens(c: Column | str) -> Column:
    """Folded parts between white space that hold a letter or digit; marks stay attached."""
    return F.filter(F.split(fold(c), f"{BLANK}+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def lines(c: Column | str) -> Column:
    return F.split(_col(c), LINE_END)


def sentences(c: Column | str) -> Column:
    """Rule-based English sentences of a text, line by line."""
    before = r"(?<![\p{L}\p{N}_])"

    def cut(line: Column) -> Column:
        x = F.regexp_replace(strip(line), f"{before}((?i:{'|'.join(ABBREVIATIONS)}))\\.", "$1" + KEPT)
        x = F.regexp_replace(x, rf"{before}([A-Z])\.(?={BLANK}+[A-Z][a-z])", "$1" + KEPT)
        x = F.regexp_replace(x, rf"{before}((?:[A-Za-z][.{KEPT}])+[A-Za-z])\.(?={BLANK}+[a-z])", "$1" + KEPT)
        ends = f".!?。！？{KEPT}"
        x = F.regexp_replace(x, rf"([{ends}]*[.!?。！？][{ends}]*[\"'”’)\]]*)(?={BLANK}|$)", "$1" + CUT)
        return F.transform(F.split(x, CUT), lambda s: F.replace(strip(s), F.lit(KEPT), F.lit(".")))

    return F.filter(F.flatten(F.transform(lines(c), cut)), lambda s: s != "")


def conditioned(c: Column | str, condition: str) -> Column:
    """Tokens under one of four cumulative conditions: A blanks only, B tokens, C without stop words, D stemmed."""
    from lexifold.functions.porter import stems

    if condition == "A":
        return basic_tokens(c)
    found = tokens(c)
    if condition in ("C", "D"):
        found = without_stop_words(found)
    if condition not in ("B", "C", "D"):
        raise ValueError(f"unknown condition {condition!r}")
    return stems(found) if condition == "D" else found


def safe_csv(c: Column | str) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(_col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), _col(c))).otherwise(_col(c))


def html_escaped(c: Column | str) -> Column:
    x = _col(c)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def html_text(c: Column | str) -> Column:
    """Text of an HTML page by its tags alone: scripts and styles dropped, block elements on their own lines."""
    x = F.regexp_replace(_col(c), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|title)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    parts = F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, f"{BLANK}+", " ")))
    return F.array_join(F.filter(parts, lambda s: s != ""), "\n")
