"""Identifiers: normal forms, batches, links, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexifold.functions.text import _col, strip

HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def pmid(c: Column | str) -> Column:
    """Digits of a PMID with or without its prefix; null for anything else."""
    return _or_null(F.regexp_extract(strip(c), r"^(?i:PMID\s*[:#]?\s*)?([1-9][0-9]{0,11})$", 1))


def pmcid(c: Column | str) -> Column:
    """Upper-case PMCID; null for anything else."""
    x = strip(c)
    return F.when(x.rlike(r"^(?i:PMC)[1-9][0-9]{0,11}$"), F.upper(x))


def arxiv(c: Column | str) -> Column:
    """Base id of an arXiv id or address, lower-case and without version; null for anything else."""
    x = F.try_url_decode(F.replace(strip(c), F.lit("+"), F.lit("%2B")))
    x = F.coalesce(x, strip(c))
    url = x.rlike(r"^https?://")
    host = F.lower(F.regexp_extract(x, r"^https?://([^/?#:]*)", 1))
    path = F.regexp_extract(x, r"^https?://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"^/(?:abs|pdf)/", ""), r"\.pdf$", "")
    x = F.when(url, F.when(host.isin(*HOSTS), path)).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(x, r"^(?i:arxiv)\s*:\s*", ""), r"(?i:v)[1-9][0-9]*$", "")
    return F.when(x.rlike(r"^(?:[0-9]{4}\.[0-9]{4,5}|[A-Za-z][A-Za-z0-9.\-]*/[0-9]{7})$"), F.lower(x))


def batch(c: Column | str, kind: str = "pmid") -> Column:
    """Pieces of a pasted list of PMIDs or arXiv ids, in order and with repeats."""
    prefix = r"(?i:PMID)\s*[:#]?\s*(?=[0-9])" if kind == "pmid" else r"(?i:arxiv)\s*:\s*(?=[A-Za-z0-9])"
    x = F.regexp_replace(_col(c), prefix, "")
    return F.filter(F.split(x, r"[\s,;，；]+"), lambda p: p != "")


def default_query(title: Column | str, source: Column | str) -> Column:
    phrase = strip(F.regexp_replace(_col(title), r'["\\]', " "))
    fielded = F.when(phrase == "", "").otherwise(F.format_string('(ti:"%s" OR abs:"%s")', phrase, phrase))
    return F.when(_col(source) == "arxiv", fielded).otherwise(F.concat(strip(title), F.lit("[Title/Abstract]")))


def tidy_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def slug(title: Column | str) -> Column:
    """Stable id of a topic: its words joined by hyphens, at most 36 signs, and eight digits of its digest."""
    x = tidy_title(title)
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 36)
    return F.concat_ws("-", F.when(base == "", "topic").otherwise(base), F.substring(F.sha2(F.lower(x), 256), 1, 8))


def link(c: Column | str) -> Column:
    """Address of a document by its id's prefix; null without one."""
    x = _col(c)
    return (
        F.when(x.rlike(r"^PMC[1-9][0-9]*$"), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), x, F.lit("/")))
        .when(x.rlike(r"^PMID[1-9][0-9]*$"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.substring(x, 5, 40), F.lit("/")))
        .when(x.startswith("ARXIV:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substring(x, 7, 400)))
    )


def download_name(number: Column | str, filename: Column | str) -> Column:
    """``article-007.xml``: a document's number and its file's ending."""
    return F.concat(F.format_string("article-%03d", _col(number)), F.regexp_extract(_col(filename), r"(\.[^./]*)$", 1))
