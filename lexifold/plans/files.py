"""Queries over article files: table rows written as the files a service would send, and read back by the file sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import text as X
from lexifold.plans import parts as Q
from lexifold.plans.retrieval import _once
from lexifold.runtime import load, new_path
from lexifold.sources import articles as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PER_FILE = 200  # article numbers
UNSEEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"  # not allowed in XML


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row's ``content`` to the file ``name`` of the folder, where they lie; the number of files.

    A task that is run again writes the same files.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "content").mapInArrow(task, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _escaped(c: str) -> Column:
    x = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), UNSEEN, " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def _records(articles: DataFrame) -> dict[str, tuple[Column, DataFrame, Column, Column]]:
    """By file name's start: ending, rows, a record's text, the file around its records."""
    parsed = articles.filter("text_state = 'parsed'").filter(F.col("abstract").rlike("[^" + X.BLANK[1:]))
    title, abstract, body, doi, journal = (_escaped(c) for c in ("title", "abstract", "body", "doi", "journal"))
    number = lambda prefix: F.substring("article_id", len(prefix) + 1, 100)
    pubmed = parsed.filter(F.col("article_id").rlike("^PMID[1-9][0-9]*$"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    joined = lambda sep="": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_no", "record"))), lambda r: r.record), sep)
    return {
        "pubmed_x": (
            F.lit(".xml"), pubmed,
            text("<PubmedArticle><MedlineCitation><PMID>", number("PMID"), "</PMID><Article><ArticleTitle>", title, "</ArticleTitle><Abstract><AbstractText>", abstract,
                 '</AbstractText></Abstract><ELocationID EIdType="doi">', doi, "</ELocationID><Journal><Title>", journal, "</Title></Journal></Article></MedlineCitation></PubmedArticle>"),
            text("<PubmedArticleSet>", joined(), "</PubmedArticleSet>"),
        ),
        "jats": (
            F.lit(".nxml"), parsed.filter(F.col("article_id").rlike("^PMC[1-9][0-9]*$")).filter(F.col("body").rlike("[^" + X.BLANK[1:])),
            text("<article><front><journal-meta><journal-title-group><journal-title>", journal, '</journal-title></journal-title-group></journal-meta><article-meta><article-id pub-id-type="pmc">', number("PMC"),
                 '</article-id><article-id pub-id-type="doi">', doi, "</article-id><title-group><article-title>", title, "</article-title></title-group><abstract><title>Abstract</title><p>", abstract,
                 "</p></abstract></article-meta></front><body><sec><title>Text</title><p>", body, "</p><ref-list><p>none</p></ref-list></sec></body></article>"),
            text("<articles>", joined(), "</articles>"),
        ),
        "atom": (
            F.lit(".xml"), parsed.filter(F.col("article_id").rlike("^ARXIV:[0-9]{4}[.][0-9]{4,5}$")),
            text("<entry><id>http://arxiv.org/abs/", number("ARXIV:"), "v2</id><title>", title, "</title><summary>", abstract, "</summary><arxiv:doi>", doi, "</arxiv:doi></entry>"),
            text('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">', joined(), "</feed>"),
        ),
        "pubmed_j": (
            F.lit(".json"), pubmed,
            F.to_json(F.struct(number("PMID").alias("pmid"), F.coalesce("title", F.lit("")).alias("title"), F.col("abstract"))),
            text('{"documents": [', joined(", "), "]}"),
        ),
    }


def _folder(spark: SparkSession, folder: str) -> str:
    def made() -> str:
        path = new_path(spark, "files")
        for start, (ending, rows, record, whole) in _records(load(spark, folder, "articles")).items():
            name = F.concat(F.lit(start), F.floor(F.col("article_no") / PER_FILE).cast("string"), ending).alias("name")
            write_files(rows.select(name, "article_no", record.alias("record")).groupBy("name").agg(whole.alias("content")), path)
        return path

    return _once(spark, folder, "files", made)


def _read(spark: SparkSession, folder: str, start: str) -> DataFrame:
    return A.read(A.files(spark, _folder(spark, folder))).filter(F.startswith(F.col("filename"), F.lit(start)))


def _seen(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{UNSEEN}', ' ', 'g')"


def _lines(c: str) -> str:
    tidy = Q.strip(f"regexp_replace(x, '{Q.BLANK}+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({_seen(c)}, '{Q.LINE_END}'), lambda x: {tidy}), lambda x: x <> ''), chr(10))"


def _words(c: str) -> str:
    return Q.strip(f"regexp_replace({_seen(c)}, '{Q.BLANK}+', ' ', 'g')")


def _titled(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '(Untitled)' ELSE {x} END"


_TITLE = "coalesce(title, '')"
_PARSED = f"parsed AS (SELECT *, (article_no // {PER_FILE})::VARCHAR AS f FROM articles WHERE text_state = 'parsed' AND regexp_matches(abstract, '[^{Q.BLANK[1:]}'))"
_PUBMED = "pub AS (SELECT * FROM parsed WHERE regexp_matches(article_id, '^PMID[1-9][0-9]*$'))"
_JATS = f"jats AS (SELECT * FROM parsed WHERE regexp_matches(article_id, '^PMC[1-9][0-9]*$') AND regexp_matches(body, '[^{Q.BLANK[1:]}'))"
_ATOM = "atom AS (SELECT * FROM parsed WHERE regexp_matches(article_id, '^ARXIV:[0-9]{4}[.][0-9]{4,5}$') QUALIFY row_number() OVER (PARTITION BY f, article_id ORDER BY article_no) = 1)"


@query(f"WITH {_PARSED}, {_PUBMED} SELECT 'pubmed_x' || f || '.xml' AS filename, article_id AS id, {_titled(_lines('title'))} AS title, {_lines('abstract')} AS abstract, {Q.strip(_seen('doi'))} AS doi, {_lines('journal')} AS journal FROM pub")
def src_pubmed_xml(spark, folder):
    return _read(spark, folder, "pubmed_x").select("filename", "id", "title", "abstract", "doi", "journal")


@query(f"WITH {_PARSED}, {_JATS} SELECT 'jats' || f || '.nxml' AS filename, article_id AS id, {_titled(_lines('title'))} AS title, {_lines('abstract')} AS abstract, {_lines('body')} AS body, {Q.strip(_seen('doi'))} AS doi, {_lines('journal')} AS journal FROM jats")
def src_jats_xml(spark, folder):
    return _read(spark, folder, "jats").select("filename", "id", "title", "abstract", "body", "doi", "journal")


@query(f"WITH {_PARSED}, {_ATOM} SELECT 'atom' || f || '.xml' AS filename, article_id AS id, {_titled(_words('title'))} AS title, {_words('abstract')} AS abstract, {Q.strip(_seen('doi'))} AS doi, 'arXiv preprint' AS journal FROM atom")
def src_arxiv_atom(spark, folder):
    return _read(spark, folder, "atom").select("filename", "id", "title", "abstract", "doi", "journal")


@query(f"WITH {_PARSED}, {_PUBMED} SELECT 'pubmed_j' || f || '.json' AS filename, article_id AS id, {_titled(Q.strip(_TITLE))} AS title, {Q.strip('abstract')} AS abstract FROM pub")
def src_json(spark, folder):
    return _read(spark, folder, "pubmed_j").select("filename", "id", "title", "abstract")


@query(
    f"""WITH {_PARSED}, {_PUBMED}, {_JATS}, {_ATOM}, held AS (SELECT 'pubmed_x' || f || '.xml' AS filename, article_id AS id, article_no FROM pub UNION ALL SELECT 'pubmed_j' || f || '.json', article_id, article_no FROM pub
    UNION ALL SELECT 'jats' || f || '.nxml', article_id, article_no FROM jats UNION ALL SELECT 'atom' || f || '.xml', article_id, article_no FROM atom)
    SELECT id, filename FROM held QUALIFY row_number() OVER (PARTITION BY id ORDER BY filename, article_no) = 1"""
)
def src_files(spark, folder):
    found, _ = A.loaded(A.read(A.files(spark, _folder(spark, folder))))
    return found.select("id", "filename")


_GONE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract, '(?is)<script\\b.*?</script\\s*>|<!--.*?-->', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<head\\b.*?</head\\s*>', '', 'g'), '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|article|section|nav|footer|title)\\b[^>]*>', chr(10), 'g')"


@query(
    f"""SELECT article_no, array_to_string(list_filter(list_transform(string_split(regexp_replace({_GONE}, '<[^>]*>', '', 'g'), chr(10)), lambda s: trim(regexp_replace(s, '{Q.BLANK}+', ' ', 'g'))), lambda s: s <> ''), chr(10)) AS text
    FROM articles WHERE text_state = 'as_received' AND abstract IS NOT NULL"""
)
def html_text(spark, folder):
    return load(spark, folder, "articles").filter("text_state = 'as_received' AND abstract IS NOT NULL").select("article_no", X.html_text("abstract").alias("text"))
