"""Queries over documents, tokens, search and export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.functions import ids as I
from lexifold.functions import text as X
from lexifold.functions.porter import porter_stem, stem
from lexifold.operators import documents as D
from lexifold.operators import index as N
from lexifold.operators import search as S
from lexifold.plans import parts as Q
from lexifold.runtime import kept, load, new_path, spread

AND, OR, PHRASE, ONE = "cohort residual", "training the seizure", "the main driver of", "cohorts"
SCOPE = "PMC3002186"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL it is compared with."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_HELD: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, what: str, make):
    """What a session's queries over one folder share, made by the first that asks: a service builds its index once, too."""
    key = spark.sparkContext.applicationId, folder, what
    if key not in _HELD:
        with kept():
            _HELD[key] = make()
    return _HELD[key]


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "docs", lambda: spread(D.active(load(spark, folder, "articles"), load(spark, folder, "deleted_documents"))))


def numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "numbers", lambda: D.numbered(docs(spark, folder), load(spark, folder, "document_numbers")))


def index(spark: SparkSession, folder: str) -> N.Index:
    def made() -> N.Index:
        path = new_path(spark, "index")
        N.write_index(docs(spark, folder), path)
        return N.open_index(spark, path)

    return _once(spark, folder, "index", made)


@query(f"WITH {Q.DOCS} SELECT collection_id, id, article_no, title FROM docs")
def active_docs(spark, folder):
    return docs(spark, folder).select("collection_id", "id", "article_no", "title")


@query("SELECT collection_id, article_id AS id, min(article_no)::BIGINT AS article_no FROM articles GROUP BY ALL")
def dedup_keep_first(spark, folder):
    return D.keep_first(D.uniform(load(spark, folder, "articles"))).select("collection_id", "id", "article_no")


@query(f"WITH {Q.DOCS}, {Q.NUMBERS} SELECT collection_id, id, number FROM numbers")
def doc_numbers(spark, folder):
    return numbers(spark, folder)


@query(f"WITH {Q.TERMS}, {Q.COUNTS} SELECT * FROM counts")
def doc_counts(spark, folder):
    return D.counts(docs(spark, folder))


@query(
    f"""WITH {Q.TERMS}, {Q.COUNTS} SELECT collection_id, count(*)::BIGINT AS documents, sum(words)::BIGINT AS words, sum(sentences)::BIGINT AS sentences, any_value(index_terms)::BIGINT AS index_terms
    FROM counts JOIN (SELECT d.collection_id, count(DISTINCT stem) AS index_terms FROM docs d LEFT JOIN trm USING (collection_id, id) GROUP BY ALL) USING (collection_id) GROUP BY ALL"""
)
def collection_metrics(spark, folder):
    held = docs(spark, folder)
    sums = D.counts(held).groupBy("collection_id").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"))
    terms = N.with_terms(held).select("collection_id", F.explode_outer("terms").alias("term")).groupBy("collection_id").agg(F.count_distinct("term").alias("index_terms"))
    return sums.join(terms, "collection_id")


@query(f"WITH {Q.DOCS}, {Q.TOK} SELECT collection_id, id, pos::BIGINT AS pos, token FROM tok WHERE region = 'abstract'")
def tok_tokens(spark, folder):
    return docs(spark, folder).select("collection_id", "id", F.posexplode(X.tokens("abstract")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {Q.TERMS} SELECT collection_id, id, stem AS term, count(*)::BIGINT AS n FROM trm WHERE region = 'abstract' GROUP BY ALL")
def tok_terms(spark, folder):
    terms = docs(spark, folder).select("collection_id", "id", X.without_stop_words(X.tokens("abstract")).alias("w"))
    return terms.select("collection_id", "id", F.explode(D._stems(F.col("w"))).alias("term")).groupBy("collection_id", "id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {Q.DOCS}, {Q.TOK}, {Q.stems('tok')} SELECT token, stem FROM stemmed")
def stem_vocab(spark, folder):
    words = N.whole_text(docs(spark, folder)).select(F.explode(X.tokens("text")).alias("token")).distinct()
    return words.select("token", porter_stem("token").alias("stem"))


@query(f"WITH {Q.DOCS} SELECT collection_id, id, generate_subscripts(l, 1)::BIGINT - 1 AS pos, unnest(l) AS sentence FROM (SELECT collection_id, id, {Q.sentences('abstract')} AS l FROM docs)")
def sent_split(spark, folder):
    return docs(spark, folder).select("collection_id", "id", F.posexplode(X.sentences("abstract")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {Q.DOCS} SELECT collection_id, id, len({Q.sentences('abstract')})::BIGINT AS n FROM docs")
def sent_count(spark, folder):
    return docs(spark, folder).select("collection_id", "id", F.size(X.sentences("abstract")).cast("bigint").alias("n"))


@query(f"WITH {Q.TERMS} SELECT collection_id, id, stem AS term, count(*)::BIGINT AS tf FROM trm GROUP BY ALL")
def postings(spark, folder):
    return N.postings(docs(spark, folder))


@query(
    f"""WITH {Q.DOCS}, {Q.TOK}, {Q.stems('tok')} SELECT collection_id, id, stem AS term, count(*) FILTER (region = 'abstract')::BIGINT AS tf_abstract,
    count(*) FILTER (region = 'body')::BIGINT AS tf_body, count(*)::BIGINT AS tf_full FROM tok JOIN stemmed USING (token) GROUP BY ALL"""
)
def doc_stem_tf(spark, folder):
    return N.stem_frequencies(docs(spark, folder))


@query(f"WITH {Q.scored([])} SELECT collection_id, n::BIGINT AS documents, round(avg_length, 6)::DOUBLE AS avg_length FROM topic")
def collection_stats(spark, folder):
    return N.statistics(docs(spark, folder)).withColumn("avg_length", F.round("avg_length", 6))


# --- search ------------------------------------------------------------------


@query(f"WITH {Q.scored([])} SELECT dl.collection_id, count(*)::BIGINT AS documents, sum(length)::BIGINT AS length FROM dl GROUP BY ALL")
def index_build(spark, folder):
    """The index written anew, and what each topic then holds."""
    path = new_path(spark, "index")
    N.write_index(docs(spark, folder), path)
    return N.open_index(spark, path).counts.groupBy("collection_id").agg(F.count("*").alias("documents"), F.sum("length").alias("length"))


@query(f"WITH {Q.TERMS} SELECT collection_id, id, stem AS term, count(*)::BIGINT AS tf FROM trm GROUP BY ALL")
def index_postings(spark, folder):
    return index(spark, folder).postings.filter("tf > 0").select("collection_id", "id", "term", "tf")


@query(f"SELECT unnest([{Q.listed(S.query_terms(OR))}]) AS term")
def query_terms(spark, folder):
    return spark.createDataFrame([(t,) for t in S.query_terms(OR)], "term string")


def _search(name: str, text: str, mode: str, doc_id: str | None = None) -> None:
    phrase = [stem(t) for t in S.query_tokens(text)]
    sql = f"WITH {Q.hits(S.query_terms(text), mode, phrase, doc_id)} SELECT * FROM hits"
    f = lambda spark, folder: S.search(index(spark, folder), text, mode, doc_id)
    f.__name__ = name
    query(sql)(f)


_search("search_and", AND, "AND")
_search("search_or", OR, "OR")
_search("search_phrase", PHRASE, "PHRASE")
_search("search_stop_words", "the of", "OR")
_search("search_stop_phrase", "of the", "PHRASE")
_search("search_unknown", "cohort zzzz", "AND")
_search("search_scoped", "metabolite plots", "OR", SCOPE)
_search("search_ranked", "cohort cohorts training of seizures", "OR")


@query(f"WITH {Q.hits(S.query_terms('metabolite plots'), 'OR')} SELECT * FROM hits")
def search_scope_unknown(spark, folder):
    """A scope that no topic holds, where the caller wants it passed over."""
    return S.search(index(spark, folder), "metabolite plots", "OR", "no such id", unknown="all")


@query(f"WITH {Q.scored(S.query_terms(OR))} SELECT collection_id, id, matched::BIGINT AS matched, round(score, 6)::DOUBLE AS score FROM scored")
def bm25_scores(spark, folder):
    held = index(spark, folder)
    none = F.lit(0).cast("bigint")
    every = held.counts.select("collection_id", "id").join(S.scored(held, S.query_terms(OR)), ["collection_id", "id"], "left")
    return every.select("collection_id", "id", F.coalesce("matched", none).alias("matched"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(f"WITH {Q.hits(S.query_terms(OR), 'OR')} SELECT *, round(100 * score / max(score) OVER (PARTITION BY collection_id), 4)::DOUBLE AS width FROM hits QUALIFY rank <= 100")
def search_top100(spark, folder):
    hits = S.search(index(spark, folder), OR, "OR", top=100)
    best = hits.groupBy("collection_id").agg(F.max("score").alias("best"))
    return hits.join(best, "collection_id").select("collection_id", "id", "score", "rank", F.round(100 * F.col("score") / F.col("best"), 4).alias("width"))


@query(
    f"""WITH {Q.hits(S.query_terms(AND), 'AND')}, {Q.COUNTS} SELECT collection_id, count(*)::BIGINT AS documents, sum(characters)::BIGINT AS characters, sum(words)::BIGINT AS words,
    sum(sentences)::BIGINT AS sentences FROM hits JOIN counts USING (collection_id, id) GROUP BY ALL"""
)
def search_totals(spark, folder):
    held = index(spark, folder)
    found = S.hits(held, AND, "AND").select("collection_id", "id")
    return held.counts.join(found, ["collection_id", "id"]).groupBy("collection_id").agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("characters", "words", "sentences")])


_FULL = "fst AS MATERIALIZED (SELECT collection_id, id, stem AS term, count(*) FILTER (region = 'abstract') AS a, count(*) FILTER (region = 'body') AS b FROM tok JOIN stemmed USING (token) GROUP BY ALL)"


@query(
    f"""WITH {Q.hits(S.query_terms(OR), 'OR')}, {_FULL} SELECT collection_id, term, count(*)::BIGINT AS documents, coalesce(sum(CASE WHEN h.id IS NOT NULL THEN a END), 0)::BIGINT AS tf_abstract,
    coalesce(sum(CASE WHEN h.id IS NOT NULL THEN b END), 0)::BIGINT AS tf_body, coalesce(sum(CASE WHEN h.id IS NOT NULL THEN a + b END), 0)::BIGINT AS tf_full,
    CASE WHEN term IN ({Q.listed(S.query_terms(OR))}) THEN 'effective' ELSE 'ignored' END AS status
    FROM fst LEFT JOIN hits h USING (collection_id, id) WHERE term IN ({Q.listed(S.query_stems(OR))}) GROUP BY ALL"""
)
def search_term_table(spark, folder):
    return S.term_table(index(spark, folder), OR, "OR")


@query(
    f"WITH {Q.DOCS}, {Q.TOK}, {Q.stems('tok')}, {_FULL} SELECT collection_id, id, term, a::BIGINT AS tf_abstract, b::BIGINT AS tf_body, (a + b)::BIGINT AS tf_full FROM fst WHERE term IN ({Q.listed(S.query_stems(OR))})"
)
def doc_term_counts(spark, folder):
    return S.document_counts(index(spark, folder), OR)


@query(
    f"""WITH {Q.DOCS}, {Q.NUMBERS} SELECT collection_id, number, id, title FROM docs JOIN numbers USING (collection_id, id)
    WHERE contains(lower(format('{{:03d}}', number) || ' ' || id || ' ' || title), 'cohort') AND contains(lower(format('{{:03d}}', number) || ' ' || id || ' ' || title), 'pmid')
    QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY number) <= 200"""
)
def library_filter(spark, folder):
    return S.library(docs(spark, folder), numbers(spark, folder), "cohort PMID")


def _pieces(text: str, source: str, stemmed: str) -> str:
    """Select of collection_id, id and the marked text: tokens and the signs between them, put together again."""
    escaped = "replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
    return f"""SELECT collection_id, id, coalesce(string_agg(CASE WHEN stem IN ({Q.listed(S.query_stems(OR))}) THEN '<mark>' || {escaped} || '</mark>' ELSE {escaped} END, '' ORDER BY k), '') AS marked FROM (
      SELECT collection_id, id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT collection_id, id, regexp_extract_all({text}, '(?s){Q.TOKEN}|.') AS l FROM {source})) LEFT JOIN {stemmed} s ON s.token = {Q.fold("p")} GROUP BY ALL"""


@query(
    f"""WITH {Q.DOCS}, {Q.TOK}, {Q.stems('tok')}, m AS ({_pieces('abstract', 'docs', 'stemmed')}) SELECT d.collection_id, d.id, coalesce(m.marked, '') AS marked FROM docs d LEFT JOIN m USING (collection_id, id)"""
)
def highlight(spark, folder):
    return docs(spark, folder).select("collection_id", "id", S.highlight(OR)("abstract").alias("marked"))


def _renamed(sql: str) -> str:
    return re.sub(r"\b(vocab|stemmed|p)(\d?)\b", lambda m: m.group() if m.group() == "p" else f"cut_{m.group()}", sql)


@query(
    f"""WITH {Q.DOCS}, {Q.TOK}, {Q.stems('tok')}, whole AS MATERIALIZED (SELECT collection_id, id, CASE WHEN abstract = '' THEN body WHEN body = '' THEN abstract ELSE abstract || chr(10) || body END AS text FROM docs),
    each AS (SELECT collection_id, id, p, k, sum(length(p)) OVER (PARTITION BY collection_id, id ORDER BY k) - length(p) AS off FROM (
      SELECT collection_id, id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT collection_id, id, regexp_extract_all(text, '(?s){Q.TOKEN}|.') AS l FROM whole))),
    hit AS (SELECT collection_id, id, min(off) AS off FROM each JOIN stemmed s ON s.token = {Q.fold("p")} WHERE stem IN ({Q.listed(S.query_stems(OR))}) GROUP BY ALL),
    slice AS MATERIALIZED (SELECT collection_id, id, start, length(text) AS n, substr(text, start + 1, 420) AS t FROM (SELECT w.*, greatest(0, coalesce(off, 0) - 100)::BIGINT AS start FROM whole w LEFT JOIN hit USING (collection_id, id))),
    slice_tok AS (SELECT {Q.fold("t2")} AS token FROM (SELECT unnest(regexp_extract_all(t, '{Q.TOKEN}')) AS t2 FROM slice)), {_renamed(Q.stems('slice_tok'))},
    m AS ({_pieces('t', 'slice', 'cut_stemmed')})
    SELECT s.collection_id, s.id, CASE WHEN start > 0 THEN '…' ELSE '' END || coalesce(marked, '') || CASE WHEN start + 420 < n THEN '…' ELSE '' END AS snippet FROM slice s LEFT JOIN m USING (collection_id, id)"""
)
def snippet(spark, folder):
    return N.whole_text(docs(spark, folder)).select("collection_id", "id", S.snippet(OR)("text").alias("snippet"))


# --- export ------------------------------------------------------------------

_SAFE = r"CASE WHEN regexp_matches({0}, '^[=+\-@\t\r]') THEN '''' || {0} ELSE {0} END"


@query(f"WITH {Q.DOCS} SELECT collection_id, id, {_SAFE.format('title')} AS title, {_SAFE.format('abstract')} AS abstract FROM docs")
def safe_csv(spark, folder):
    return docs(spark, folder).select("collection_id", "id", X.safe_csv("title").alias("title"), X.safe_csv("abstract").alias("abstract"))


@query(
    f"""WITH {Q.hits(S.query_terms(OR), 'OR')}, {Q.NUMBERS}, {Q.COUNTS} SELECT collection_id, rank, number, id, {_SAFE.format('title')} AS title, score AS bm25, characters, characters_no_space, words,
    sentences, indexed_terms, unique_terms, {_SAFE.format('filename')} AS filename
    FROM hits JOIN docs USING (collection_id, id) JOIN numbers USING (collection_id, id) JOIN counts USING (collection_id, id)"""
)
def csv_results(spark, folder):
    from lexifold.sinks.csv import result_rows

    held = index(spark, folder)
    return result_rows(docs(spark, folder), S.search(held, OR, "OR"), numbers(spark, folder), held.counts)


# --- identifiers ---------------------------------------------------------------


@query("SELECT record_no, CASE WHEN m <> '' THEN m END AS pmid FROM (SELECT record_no, regexp_extract(trim(pmid), '^(?:(?i)PMID\\s*[:#]?\\s*)?([1-9][0-9]{0,11})$', 1) AS m FROM pubmed_records)")
def norm_pmid(spark, folder):
    return load(spark, folder, "pubmed_records").select("record_no", I.pmid("pmid").alias("pmid"))


@query("SELECT article_no, CASE WHEN regexp_matches(article_id, '^(?i)PMC[1-9][0-9]{0,11}$') THEN upper(article_id) END AS pmcid FROM articles")
def norm_pmcid(spark, folder):
    return load(spark, folder, "articles").select("article_no", I.pmcid("article_id").alias("pmcid"))


@query(
    """SELECT article_no, CASE WHEN regexp_matches(x, '^(?:[0-9]{4}\\.[0-9]{4,5}|[A-Za-z][A-Za-z0-9.\\-]*/[0-9]{7})$') THEN lower(x) END AS arxiv
    FROM (SELECT article_no, regexp_replace(regexp_replace(article_id, '^(?i)arxiv\\s*:\\s*', ''), '[vV][1-9][0-9]*$', '') AS x FROM articles)"""
)
def norm_arxiv(spark, folder):
    return load(spark, folder, "articles").select("article_no", I.arxiv("article_id").alias("arxiv"))


@query(
    """SELECT article_no, CASE article_no % 6 WHEN 2 THEN NULL ELSE lower(x) END AS arxiv FROM (SELECT article_no, regexp_replace(article_id[7:], '[vV][1-9][0-9]*$', '') AS x FROM articles
    WHERE regexp_matches(article_id, '^ARXIV:([0-9]{4}[.][0-9]{4,5}|[A-Za-z-]+/[0-9]{7})$'))"""
)
def norm_arxiv_urls(spark, folder):
    """Ids as they stand in addresses: with version, file ending, percent signs, foreign hosts."""
    ids = load(spark, folder, "articles").filter(F.col("article_id").rlike(r"^ARXIV:(?:[0-9]{4}[.][0-9]{4,5}|[A-Za-z-]+/[0-9]{7})$"))
    x, form = F.substring("article_id", 7, 100), F.col("article_no") % 6
    said = (
        F.when(form == 0, F.concat(F.lit("https://arxiv.org/abs/"), x))
        .when(form == 1, F.concat(F.lit(" http://www.arxiv.org/pdf/"), x, F.lit("v12.pdf")))
        .when(form == 2, F.concat(F.lit("https://arxiv.example.invalid/abs/"), x))
        .when(form == 3, F.concat(F.lit("arXiv%3A"), F.replace(x, F.lit("/"), F.lit("%2F")), F.lit("v2")))
        .when(form == 4, F.concat(F.lit("https://export.arxiv.org/abs/"), F.upper(x), F.lit("?context=q-bio")))
        .otherwise(F.concat(F.lit("ARXIV : "), x))
    )
    return ids.select("article_no", I.arxiv(said).alias("arxiv"))


@query(
    """SELECT article_no, CASE WHEN regexp_matches(article_id, '^PMC[1-9][0-9]*$') THEN 'https://pmc.ncbi.nlm.nih.gov/articles/' || article_id || '/'
    WHEN regexp_matches(article_id, '^PMID[1-9][0-9]*$') THEN 'https://pubmed.ncbi.nlm.nih.gov/' || article_id[5:] || '/'
    WHEN starts_with(article_id, 'ARXIV:') THEN 'https://arxiv.org/abs/' || article_id[7:] END AS link FROM articles"""
)
def doc_link(spark, folder):
    return load(spark, folder, "articles").select("article_no", I.link("article_id").alias("link"))


@query(
    """SELECT collection_id, CASE WHEN source <> 'arxiv' THEN trim(title) || '[Title/Abstract]' WHEN trim(replace(title, '"', ' ')) = '' THEN ''
    ELSE '(ti:"' || trim(replace(title, '"', ' ')) || '" OR abs:"' || trim(replace(title, '"', ' ')) || '")' END AS default_query FROM collections"""
)
def default_query(spark, folder):
    return load(spark, folder, "collections").select("collection_id", I.default_query("title", "source").alias("default_query"))


@query(
    """SELECT collection_id, CASE WHEN base = '' THEN 'topic' ELSE base END || '-' || sha256(lower(tidy))[1:8] AS slug FROM (SELECT collection_id, tidy,
    left(regexp_replace(regexp_replace(lower(tidy), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 36) AS base
    FROM (SELECT collection_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS tidy FROM collections))"""
)
def slugify(spark, folder):
    return load(spark, folder, "collections").select("collection_id", I.slug("title").alias("slug"))


@query(f"WITH {Q.DOCS}, {Q.NUMBERS} SELECT collection_id, id, 'article-' || lpad(number::VARCHAR, greatest(3, length(number::VARCHAR))::INT, '0') || coalesce(regexp_extract(filename, '(\\.[^./]*)$', 1), '') AS name FROM docs JOIN numbers USING (collection_id, id)")
def raw_names(spark, folder):
    """What a document's file is called when it is handed out."""
    listed = docs(spark, folder).select("collection_id", "id", "filename").join(numbers(spark, folder), ["collection_id", "id"])
    return listed.select("collection_id", "id", I.download_name("number", "filename").alias("name"))


@query("SELECT article_no, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS title FROM articles WHERE title IS NOT NULL")
def html_escaped(spark, folder):
    return load(spark, folder, "articles").filter("title IS NOT NULL").select("article_no", X.html_escaped("title").alias("title"))
