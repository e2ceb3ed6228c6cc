"""Queries over vocabulary statistics, spelling, embeddings and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexifold.operators import catalog as C
from lexifold.operators import embedding as E
from lexifold.operators import spelling as L
from lexifold.operators import zipf as Z
from lexifold.plans import parts as Q
from lexifold.plans.retrieval import ONE, docs, index, numbers
from lexifold.runtime import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LEFT, RIGHT = "gut-peptides-c894e587", "coastal-sediment-0afb96a1"
MISSPELT = ("cohrt", "residul", "trainng", "the", "zzzzzz", "cat", "h2o", "seizures")


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# --- vocabulary ------------------------------------------------------------------

for _c in Z.CONDITIONS:
    query(f"WITH {Q.condition(_c)} SELECT collection_id, id, term, count(*)::BIGINT AS tf FROM zt GROUP BY ALL", f"zipf_tokens_{_c}")(
        lambda spark, folder, c=_c: Z.document_tf(docs(spark, folder), c)
    )
    query(f"WITH {Q.frequencies(_c)} SELECT collection_id, term, cf, df FROM freq", f"term_cf_df_{_c}")(lambda spark, folder, c=_c: Z.frequencies(docs(spark, folder), c))
    query(f"WITH {Q.frequencies(_c)} {Q.fit('ranked', 'collection_id')}", f"zipf_regression_{_c}")(lambda spark, folder, c=_c: Z.regression(docs(spark, folder), c))


@query(f"WITH {Q.frequencies('D')} SELECT collection_id, term, round(ln(documents / df), 6)::DOUBLE AS idf FROM freq JOIN sizes USING (collection_id)")
def term_idf(spark, folder):
    held = docs(spark, folder)
    terms = Z.frequencies(held, "D").join(Z.sizes(held), "collection_id")
    return terms.select("collection_id", "term", F.round(Z.idf(F.col("documents"), F.col("df")), 6).alias("idf"))


def _summary(c: str) -> str:
    return f"""SELECT collection_id, documents, coalesce(sum(cf), 0)::BIGINT AS total_tokens, count(term)::BIGINT AS unique_terms,
    round(coalesce(sum(cf), 0) / documents, 6)::DOUBLE AS average_tokens FROM sizes LEFT JOIN freq USING (collection_id) GROUP BY collection_id, documents"""


@query(f"WITH {Q.frequencies('D')} {_summary('D')}")
def zipf_summary(spark, folder):
    return Z.summary(docs(spark, folder), "D")


@query(f"WITH {Q.frequencies('C')} SELECT collection_id, term, cf, df, rank FROM ranked")
def zipf_ranked(spark, folder):
    return Z.ranked(Z.frequencies(docs(spark, folder), "C"))


@query(f"WITH {Q.frequencies('B')} SELECT collection_id, term, cf, rank FROM ranked WHERE rank <= 50")
def zipf_top50(spark, folder):
    return Z.top_terms(Z.frequencies(docs(spark, folder), "B"), 50).select("collection_id", "term", "cf", "rank")


@query(
    f"""WITH {Q.frequencies('D')}, sized AS (SELECT *, count(*) OVER (PARTITION BY collection_id) AS n FROM ranked),
    parted AS (SELECT *, CASE WHEN rank <= greatest(1, n // 3) THEN 'high' WHEN rank <= greatest(2, 2 * n // 3) THEN 'middle' ELSE 'low' END AS region FROM sized)
    {Q.fit('parted', 'collection_id, region')}"""
)
def zipf_regions(spark, folder):
    return Z.regions(docs(spark, folder), "D")


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {Q.frequencies(c)}, fitted AS ({Q.fit('ranked', 'collection_id')}), summed AS ({_summary(c)}) SELECT s.*, slope, intercept, exponent, r_squared, rmse, '{c}' AS condition FROM summed s JOIN fitted USING (collection_id))"
        for c in Z.CONDITIONS
    )
)
def zipf_all_conditions(spark, folder):
    return Z.all_conditions(docs(spark, folder))


@query(
    f"""WITH {Q.frequencies('C')}, sampled AS (SELECT collection_id, n, least(n, 550) AS k FROM (SELECT collection_id, count(*) AS n FROM freq GROUP BY ALL)),
    steps AS (SELECT DISTINCT collection_id, CASE WHEN k = 1 THEN 0 ELSE round_even(i * (n - 1) / (k - 1), 0) END::BIGINT + 1 AS rank FROM (SELECT *, unnest(range(k)) AS i FROM sampled))
    SELECT collection_id, rank, term, cf FROM ranked JOIN steps USING (collection_id, rank)"""
)
def zipf_chart_points(spark, folder):
    return Z.chart_points(Z.ranked(Z.frequencies(docs(spark, folder), "C")))


@query(
    f"""WITH {Q.frequencies('C')}, fitted AS ({Q.fit('ranked', 'collection_id')}), summed AS ({_summary('C')}),
    wide AS (SELECT collection_id, documents::DOUBLE AS documents, total_tokens::DOUBLE AS total_tokens, unique_terms::DOUBLE AS unique_terms, average_tokens, slope, exponent, r_squared
      FROM summed JOIN fitted USING (collection_id) WHERE collection_id IN ('{LEFT}', '{RIGHT}')),
    long AS (UNPIVOT wide ON documents, total_tokens, unique_terms, average_tokens, slope, exponent, r_squared INTO NAME measure VALUE value)
    SELECT measure, max(value) FILTER (collection_id = '{LEFT}') AS "left", max(value) FILTER (collection_id = '{RIGHT}') AS "right",
      max(value) FILTER (collection_id = '{LEFT}') <> max(value) FILTER (collection_id = '{RIGHT}') AS differs FROM long GROUP BY ALL"""
)
def compare_domains(spark, folder):
    return Z.comparison(docs(spark, folder), LEFT, RIGHT, "C")


@query(f"WITH {Q.frequencies('C')} SELECT collection_id, term, cf, rank FROM ranked WHERE rank <= 10 AND collection_id IN ('{LEFT}', '{RIGHT}')")
def compare_top10(spark, folder):
    both = docs(spark, folder).filter(F.col("collection_id").isin(LEFT, RIGHT))
    return Z.top_terms(Z.frequencies(both, "C"), 10).select("collection_id", "term", "cf", "rank")


_TERM = Z.query_term(ONE, "D")


@query(
    f"""WITH {Q.condition('D')}, {Q.NUMBERS}, own AS (SELECT collection_id, id, count(*)::BIGINT AS tf FROM zt WHERE term = '{_TERM}' GROUP BY ALL)
    SELECT collection_id, number, id, title, '{_TERM}' AS term, tf, round(100 * tf / max(tf) OVER (PARTITION BY collection_id), 2)::DOUBLE AS width,
      row_number() OVER (PARTITION BY collection_id ORDER BY tf DESC, number)::BIGINT AS rank
    FROM own JOIN docs USING (collection_id, id) JOIN numbers USING (collection_id, id)"""
)
def term_distribution(spark, folder):
    return Z.distribution(docs(spark, folder), numbers(spark, folder), ONE, "D")


@query(f"WITH {Q.frequencies('D')} SELECT collection_id, term, cf, df, documents, round(ln(documents / df), 6)::DOUBLE AS idf FROM freq JOIN sizes USING (collection_id) WHERE term = '{_TERM}'")
def single_term_stats(spark, folder):
    held = docs(spark, folder)
    terms = Z.frequencies(held, "D").filter(F.col("term") == _TERM).join(Z.sizes(held), "collection_id")
    return terms.select("collection_id", "term", "cf", "df", "documents", F.round(Z.idf(F.col("documents"), F.col("df")), 6).alias("idf"))


_SAFE = r"CASE WHEN regexp_matches({0}, '^[=+\-@\t\r]') THEN '''' || {0} ELSE {0} END"


@query(f"WITH {Q.frequencies('A')} SELECT collection_id, rank, {_SAFE.format('term')} AS term, cf, df, round(ln(documents / df), 8)::DOUBLE AS idf FROM ranked JOIN sizes USING (collection_id)")
def csv_vocabulary(spark, folder):
    from lexifold.sinks.csv import vocabulary_rows

    return vocabulary_rows(docs(spark, folder), "A")


@query(
    f"""WITH {Q.condition('D')}, {Q.NUMBERS} SELECT collection_id, number, id AS document_id, {_SAFE.format('any_value(title)')} AS title, '{_TERM}' AS term, count(*)::BIGINT AS tf
    FROM zt JOIN docs USING (collection_id, id) JOIN numbers USING (collection_id, id) WHERE term = '{_TERM}' GROUP BY collection_id, number, id"""
)
def csv_term_distribution(spark, folder):
    from lexifold.sinks.csv import distribution_rows

    return distribution_rows(docs(spark, folder), numbers(spark, folder), ONE, "D")


# --- spelling --------------------------------------------------------------------

_VOCAB = f"""{Q.DOCS}, {Q.TOK},
vocabulary AS MATERIALIZED (SELECT collection_id, token AS word, count(*)::BIGINT AS n FROM tok WHERE token NOT IN ({Q.STOP}) AND regexp_matches(token, '^\\p{{L}}+$') GROUP BY ALL)"""
_ASKED = f"asked AS (SELECT collection_id, unnest([{Q.listed(list(MISSPELT))}]) AS word FROM (SELECT DISTINCT collection_id FROM docs))"
_NEAR = """near AS (SELECT a.collection_id, a.word, v.word AS candidate, levenshtein(a.word, v.word)::BIGINT AS distance, n
  FROM asked a JOIN vocabulary v ON a.collection_id = v.collection_id AND abs(length(a.word) - length(v.word)) <= CASE WHEN length(a.word) <= 4 THEN 1 ELSE 2 END
  WHERE levenshtein(a.word, v.word) <= CASE WHEN length(a.word) <= 4 THEN 1 ELSE 2 END)"""
_SUGGESTED = """best AS (SELECT * FROM near WHERE regexp_matches(word, '^\\p{L}{3,}$') AND NOT EXISTS (SELECT 1 FROM vocabulary v WHERE v.collection_id = near.collection_id AND v.word = near.word)
  QUALIFY row_number() OVER (PARTITION BY collection_id, word ORDER BY distance, n DESC, candidate) = 1),
suggested AS (SELECT a.collection_id, a.word, coalesce(candidate, a.word) AS suggestion FROM asked a LEFT JOIN best USING (collection_id, word))"""


def _asked(held):
    return held.select("collection_id", F.explode(F.array(*map(F.lit, MISSPELT))).alias("word"))


@query(f"WITH {_VOCAB} SELECT * FROM vocabulary")
def spell_vocab(spark, folder):
    return L.vocabulary(docs(spark, folder))


@query(f"WITH {_VOCAB}, {_ASKED}, {_NEAR} SELECT * FROM near")
def spell_candidates(spark, folder):
    held = index(spark, folder)
    return L.candidates(_asked(held.topics), held.words)


@query(f"WITH {_VOCAB}, {_ASKED}, {_NEAR}, {_SUGGESTED} SELECT * FROM suggested")
def spell_suggest(spark, folder):
    held = index(spark, folder)
    return L.suggestions(_asked(held.topics), held.words)


@query(
    f"""WITH {_VOCAB}, {_ASKED}, {_NEAR}, {_SUGGESTED}, words AS (SELECT collection_id, word, suggestion, list_position([{Q.listed(list(MISSPELT))}], word) AS pos FROM suggested)
    SELECT collection_id, '{" ".join(MISSPELT)}' AS query, CASE WHEN bool_or(word <> suggestion) THEN string_agg(suggestion, ' ' ORDER BY pos) ELSE '' END AS corrected,
      coalesce(string_agg(word || '>' || suggestion, ' ' ORDER BY pos) FILTER (word <> suggestion), '') AS changes FROM words GROUP BY ALL"""
)
def spell_query(spark, folder):
    held = index(spark, folder)
    queries = held.topics.select("collection_id").withColumn("query", F.lit(" ".join(MISSPELT)))
    return L.corrected(queries, held.words)


@query(
    """SELECT a.collection_id AS a, b.collection_id AS b, CASE WHEN levenshtein(lower(trim(a.title)), lower(trim(b.title))) > 9 THEN 10 ELSE levenshtein(lower(trim(a.title)), lower(trim(b.title))) END::BIGINT AS distance
    FROM collections a JOIN collections b ON a.source = b.source AND a.collection_id < b.collection_id"""
)
def edit_distance(spark, folder):
    held = load(spark, folder, "collections").select("collection_id", "source", F.trim("title").alias("title"))
    a, b = held.select(F.col("collection_id").alias("a"), "source", F.col("title").alias("x")), held.select(F.col("collection_id").alias("b"), "source", F.col("title").alias("y"))
    return a.join(b, "source").filter("a < b").select("a", "b", L.edit_distance(F.col("x"), F.col("y"), 9).alias("distance"))


# --- embeddings --------------------------------------------------------------------

_WORDS = f"""{Q.DOCS}, abs_tok AS MATERIALIZED (SELECT collection_id, id, article_no, pos, token FROM ({Q.tokens('abstract', 'abstract')}) WHERE token NOT IN ({Q.STOP}) AND regexp_matches(token, '^\\p{{L}}+$')),
w2v AS MATERIALIZED (SELECT collection_id, token AS word, n, place FROM (
  SELECT collection_id, token, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY collection_id ORDER BY count(*) DESC, min(article_no * 100000000 + pos))::BIGINT AS place FROM abs_tok GROUP BY collection_id, token)
  WHERE place <= 800 AND n >= 2),
seq AS MATERIALIZED (SELECT t.collection_id, id, article_no, token AS word, row_number() OVER (PARTITION BY t.collection_id, id ORDER BY pos) - 1 AS pos
  FROM abs_tok t JOIN w2v ON w2v.collection_id = t.collection_id AND w2v.word = t.token),
ctx AS MATERIALIZED (SELECT a.collection_id, a.id, a.article_no, a.pos::BIGINT AS pos, a.word AS center, b.word AS target, row_number() OVER (PARTITION BY a.collection_id, a.id, a.pos ORDER BY b.pos)::BIGINT - 1 AS k
  FROM seq a JOIN seq b ON a.collection_id = b.collection_id AND a.id = b.id AND abs(a.pos - b.pos) <= 2 AND a.pos <> b.pos)"""


def _sequences(spark, folder):
    held = docs(spark, folder)
    return E.sequences(held, E.vocabulary(held))


@query(f"WITH {_WORDS} SELECT * FROM w2v")
def w2v_vocab(spark, folder):
    return E.vocabulary(docs(spark, folder))


@query(f"WITH {_WORDS} SELECT collection_id, id, pos::BIGINT AS pos, word FROM seq")
def w2v_sequences(spark, folder):
    return _sequences(spark, folder).select("collection_id", "id", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {_WORDS} SELECT collection_id, id, pos, k, center, target FROM ctx")
def w2v_pairs_skipgram(spark, folder):
    return E.skipgram_pairs(_sequences(spark, folder)).select("collection_id", "id", "pos", "k", "center", "target")


@query(f"WITH {_WORDS} SELECT collection_id, id, pos, center, string_agg(target, ' ' ORDER BY k) AS context FROM ctx GROUP BY ALL")
def w2v_examples_cbow(spark, folder):
    return E.cbow_examples(_sequences(spark, folder)).select("collection_id", "id", "pos", "center", F.array_join("context", " ").alias("context"))


@query(f"WITH {_WORDS} SELECT collection_id, id, pos, k, center, target FROM ctx QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY article_no, pos, k) <= 60000")
def w2v_example_cap(spark, folder):
    return E.capped(E.skipgram_pairs(_sequences(spark, folder))).select("collection_id", "id", "pos", "k", "center", "target")


@query(f"WITH {_WORDS} SELECT collection_id, word, place, round(sum(pow(n, 0.75)) OVER (PARTITION BY collection_id ORDER BY place), 6)::DOUBLE AS cumulative FROM w2v")
def w2v_neg_cdf(spark, folder):
    return E.negative_cdf(E.vocabulary(docs(spark, folder)))


@query()
def w2v_train_skipgram(spark, folder):
    return E.train(docs(spark, folder), "skipgram")


@query()
def w2v_train_cbow(spark, folder):
    return E.train(docs(spark, folder), "cbow")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), met AS (
      SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6)::DOUBLE AS similarity
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::BIGINT AS rank FROM met QUALIFY rank <= 10"""
)
def nearest_vectors(spark, folder):
    """Every row whose id is divisible by 100 as a query, so their number grows with the table."""
    vectors = load(spark, folder, "embeddings")
    return E.nearest(vectors, vectors.filter("vec_id % 100 = 0"), [], "vec_id", "embedding")


@query(
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(covar_samp(a.x, b.x), 9)::DOUBLE AS covariance FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL"""
)
def vec_covariance(spark, folder):
    return E.covariance(load(spark, folder, "embeddings"), "embedding")


@query()
def pca_projection(spark, folder):
    return E.projection(load(spark, folder, "embeddings"), "vec_id", "embedding")[0]


@query(
    f"""WITH v AS (SELECT 'all' AS collection_id, vec_id::VARCHAR AS word, (label * 10)::BIGINT AS n, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    met AS (SELECT v.word, row_number() OVER (ORDER BY round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) DESC, v.word) AS rank
      FROM v q JOIN v ON q.word <> v.word WHERE q.word = '7')
    SELECT v.word, v.n FROM v LEFT JOIN met ON met.word = v.word AND rank <= 50
    QUALIFY row_number() OVER (ORDER BY CASE WHEN v.word = '7' THEN 0 WHEN rank IS NOT NULL THEN rank ELSE 1000000000 END, v.n DESC, v.word) <= 90"""
)
def pca_selection(spark, folder):
    vectors = load(spark, folder, "embeddings").select(
        F.lit("all").alias("collection_id"), F.col("vec_id").cast("string").alias("word"), (F.col("label") * 10).cast("bigint").alias("n"), F.col("embedding").alias("vector")
    )
    return E.selected(vectors, "7").select("word", "n")


# --- catalogue ---------------------------------------------------------------------


@query(f"SELECT collection_id, source, {Q.fold('coalesce(query_text, chr(0))').replace('chr(0)', repr(''))} AS query, max(coalesce(retstart, 0) + coalesce(downloaded, 0))::BIGINT AS next_offset FROM import_log GROUP BY ALL")
def next_offset(spark, folder):
    return C.next_offsets(load(spark, folder, "import_log"))


@query(
    """WITH each AS (SELECT collection_id, source, query_text, row_number() OVER (PARTITION BY collection_id, source ORDER BY created_at DESC, import_no DESC) AS n FROM import_log),
    maps AS (SELECT collection_id, string_agg(source || '=' || coalesce(query_text, '(none)'), ' | ' ORDER BY source) AS source_queries FROM each WHERE n = 1 AND source IS NOT NULL GROUP BY ALL),
    last AS (SELECT collection_id, query_text AS default_query, source FROM import_log QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC NULLS LAST, import_no DESC) = 1)
    SELECT collection_id, default_query, source, source_queries FROM last LEFT JOIN maps USING (collection_id)"""
)
def latest_queries(spark, folder):
    each = F.transform(F.array_sort(F.map_entries("source_queries")), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("(none)"))))
    return C.latest_queries(load(spark, folder, "import_log")).select("collection_id", "default_query", "source", F.array_join(each, " | ").alias("source_queries"))


@query(
    """SELECT collection_id, source, count(*)::BIGINT AS imports, coalesce(sum(requested), 0)::BIGINT AS requested, coalesce(sum(downloaded), 0)::BIGINT AS downloaded, coalesce(sum(added), 0)::BIGINT AS added,
    (coalesce(sum(requested), 0) - coalesce(sum(downloaded), 0))::BIGINT AS not_found, (coalesce(sum(downloaded), 0) - coalesce(sum(added), 0))::BIGINT AS dropped FROM import_log GROUP BY ALL"""
)
def import_report(spark, folder):
    return C.import_report(load(spark, folder, "import_log"))


_KNOWN = f"{Q.DOCS}, known AS MATERIALIZED (SELECT collection_id, id FROM docs UNION SELECT collection_id, article_id FROM deleted_documents)"


def _known(spark, folder):
    return C.known_ids(docs(spark, folder), load(spark, folder, "deleted_documents"))


def _batch(spark, folder):
    """Records as a batch on its way in: PubMed deliveries under the ids their topic would give them."""
    from lexifold.sources.payloads import pubmed_documents

    return pubmed_documents(load(spark, folder, "pubmed_records"))


@query(f"WITH {_KNOWN} SELECT * FROM known")
def known_ids_union(spark, folder):
    return _known(spark, folder)


@query(f"WITH {Q.DOCS} SELECT collection_id, id FROM docs INTERSECT SELECT collection_id, article_id FROM document_numbers")
def ids_overlap(spark, folder):
    stored = load(spark, folder, "document_numbers").select("collection_id", F.col("article_id").alias("id"))
    return docs(spark, folder).select("collection_id", "id").intersect(stored)


@query(f"WITH {Q.DOCS} SELECT collection_id, article_id AS id FROM document_numbers EXCEPT SELECT collection_id, id FROM docs")
def ids_not_found(spark, folder):
    stored = load(spark, folder, "document_numbers").select("collection_id", F.col("article_id").alias("id"))
    return stored.subtract(docs(spark, folder).select("collection_id", "id"))


_PAYLOADS = r"""ok AS MATERIALIZED (SELECT record_no, collection_id, filename, payload::JSON AS p FROM pubmed_records WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
part AS (SELECT record_no, collection_id, filename, p->>'$.MedlineCitation.PMID' AS a, p->'$.MedlineCitation.Article.Abstract.AbstractText' AS v, p->'$.MedlineCitation.PMID' AS pm FROM ok),
each AS (SELECT record_no, k, CASE WHEN json_type(v) = 'ARRAY' THEN v->(k::INT) ELSE v END AS e
  FROM (SELECT record_no, v, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::INT ELSE 1 END)) AS k FROM part WHERE v IS NOT NULL)),
txt AS (SELECT record_no, k, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' WHEN json_type(e->'$."#text"') = 'VARCHAR' THEN e->>'$."#text"' END AS t,
  trim(coalesce(nullif(e->>'$."@Label"', ''), e->>'$."@NlmCategory"', '')) AS label FROM each),
ab AS (SELECT record_no, string_agg(CASE WHEN label <> '' AND label <> 'UNASSIGNED' THEN label || ': ' || trim(regexp_replace(t, '\s+', ' ', 'g')) ELSE trim(regexp_replace(t, '\s+', ' ', 'g')) END, chr(10) ORDER BY k) AS abstract
  FROM txt WHERE trim(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g')) <> '' GROUP BY ALL),
batch AS MATERIALIZED (SELECT collection_id, 'PMID' || trim(CASE WHEN json_type(pm) = 'OBJECT' THEN pm->>'$."#text"' ELSE a END) AS id, record_no AS article_no, filename, coalesce(abstract, '') AS abstract
  FROM part LEFT JOIN ab USING (record_no) WHERE trim(coalesce(CASE WHEN json_type(pm) = 'OBJECT' THEN pm->>'$."#text"' ELSE a END, '')) <> '')"""


@query(f"WITH {_PAYLOADS} SELECT collection_id, id, article_no, filename, abstract FROM batch")
def src_pubmed_records(spark, folder):
    return _batch(spark, folder).select("collection_id", "id", "article_no", "filename", "abstract")


@query(f"WITH {_KNOWN}, {_PAYLOADS} SELECT collection_id, id, article_no FROM (SELECT * FROM batch WHERE abstract <> '' QUALIFY row_number() OVER (PARTITION BY collection_id, id ORDER BY article_no) = 1) b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.collection_id = b.collection_id AND k.id = b.id)")
def ingest_new_only(spark, folder):
    return C.new_records(_batch(spark, folder), _known(spark, folder)).select("collection_id", "id", "article_no")


@query(
    f"""WITH {_KNOWN}, {_PAYLOADS}, per AS (SELECT b.collection_id, filename, b.id, count(*) AS n, max(k.id) AS k FROM batch b LEFT JOIN known k ON k.collection_id = b.collection_id AND k.id = b.id GROUP BY ALL)
    SELECT collection_id, filename, sum(n)::BIGINT AS records, max(n) = 1 AND max(k) IS NULL AS accepted FROM per GROUP BY ALL"""
)
def ingest_gate(spark, folder):
    return C.gated_files(_batch(spark, folder), _known(spark, folder))


@query(
    f"""WITH {Q.DOCS}, {_PAYLOADS}, asked AS (SELECT DISTINCT collection_id, id FROM docs WHERE starts_with(id, 'PMID')), got AS (SELECT collection_id, id, max((abstract <> '')::INT) AS usable FROM batch GROUP BY ALL)
    SELECT a.collection_id, count(*)::BIGINT AS requested, count(usable)::BIGINT AS returned, (count(*) FILTER (usable = 1))::BIGINT AS usable, (count(*) FILTER (usable IS NULL))::BIGINT AS not_found,
      (count(*) FILTER (usable = 0))::BIGINT AS without_abstract FROM asked a LEFT JOIN got USING (collection_id, id) GROUP BY ALL"""
)
def fetch_report(spark, folder):
    asked = docs(spark, folder).filter(F.startswith(F.col("id"), F.lit("PMID")))
    return C.fetch_report(asked, _batch(spark, folder))


@query(
    """WITH lists AS (SELECT collection_id, CASE WHEN length(collection_id) % 2 = 0 THEN string_agg(coalesce(pmid, ''), ',' ORDER BY record_no) ELSE string_agg(coalesce(pmid, ''), ' ; ' ORDER BY record_no) END AS l FROM pubmed_records GROUP BY collection_id),
    pieces AS (SELECT collection_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT collection_id, list_filter(regexp_split_to_array(regexp_replace(l, '(?i:PMID)\\s*[:#]?\\s*([0-9])', '\\1', 'g'), '[\\s,;，；]+'), lambda x: x <> '') AS p FROM lists)),
    good AS (SELECT * FROM pieces WHERE collection_id NOT IN (SELECT collection_id FROM pieces WHERE NOT regexp_matches(piece, '^[1-9][0-9]*$')))
    SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY min(k))::BIGINT AS pos, piece AS pmid, count(*)::BIGINT AS times FROM good GROUP BY collection_id, piece"""
)
def id_batch(spark, folder):
    records = load(spark, folder, "pubmed_records")
    listed = F.sort_array(F.collect_list(F.struct("record_no", F.coalesce("pmid", F.lit("")).alias("p"))))
    joined = F.when(F.length("collection_id") % 2 == 0, F.array_join(F.col("l.p"), ",")).otherwise(F.array_join(F.col("l.p"), " ; "))
    lists = records.groupBy("collection_id").agg(listed.alias("l")).select("collection_id", joined.alias("l"))
    return C.parsed_batch(lists, "collection_id", "l")


@query(
    """WITH lists AS (SELECT collection_id, string_agg(coalesce(pmid, ''), ' ; ' ORDER BY record_no) AS l FROM pubmed_records WHERE record_no % 3 > 0 OR length(collection_id) % 2 = 0 GROUP BY collection_id),
    pieces AS (SELECT collection_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT collection_id, list_filter(regexp_split_to_array(regexp_replace(l, '(?i:PMID)\\s*[:#]?\\s*([0-9])', '\\1', 'g'), '[\\s,;，；]+'), lambda x: x <> '') AS p FROM lists)),
    per AS (SELECT collection_id, count(*) AS n, count(DISTINCT piece) AS d, min(k) FILTER (NOT regexp_matches(piece, '^[1-9][0-9]*$')) AS bad FROM pieces GROUP BY ALL),
    said AS (SELECT l.collection_id, coalesce(n, 0) AS n, coalesce(d, 0) AS d, CASE WHEN n IS NULL THEN 'empty' WHEN bad IS NOT NULL THEN 'invalid: ' || (SELECT piece FROM pieces p WHERE p.collection_id IS NOT DISTINCT FROM l.collection_id AND k = bad) WHEN d > 200 THEN 'more than 200' END AS error
      FROM lists l LEFT JOIN per ON l.collection_id IS NOT DISTINCT FROM per.collection_id)
    SELECT collection_id, CASE WHEN error IS NULL THEN d ELSE 0 END::BIGINT AS ids, CASE WHEN error IS NULL THEN n - d ELSE 0 END::BIGINT AS duplicates, error FROM said"""
)
def id_batch_report(spark, folder):
    records = load(spark, folder, "pubmed_records").filter("record_no % 3 > 0 OR length(collection_id) % 2 = 0")
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("record_no", F.coalesce("pmid", F.lit("")).alias("p"))))["p"], " ; ")
    report = C.batch_report(records.groupBy("collection_id").agg(listed.alias("l")), "collection_id", "l")
    return report.select("collection_id", F.size("ids").cast("bigint").alias("ids"), "duplicates", "error")


@query(f"WITH {_WORDS} SELECT collection_id, word, round(CASE WHEN place = 1 THEN 7 ELSE least(6, 3.3 + 0.35 * ln(1 + n)) END, 6)::DOUBLE AS radius FROM w2v")
def pca_radius(spark, folder):
    vocabulary = E.vocabulary(docs(spark, folder))
    return vocabulary.select("collection_id", "word", F.round(E.radius("n", F.col("place") == 1), 6).alias("radius"))


@query(
    f"""WITH {Q.DOCS}, {_PAYLOADS}, known AS (SELECT id FROM docs WHERE collection_id = '{LEFT}' UNION SELECT article_id FROM deleted_documents WHERE collection_id = '{LEFT}'),
    new AS (SELECT id FROM batch WHERE collection_id = '{LEFT}' AND trim(abstract) <> '' AND id NOT IN (SELECT id FROM known) GROUP BY id)
    SELECT id, 'held' AS via FROM docs WHERE collection_id = '{LEFT}' UNION ALL SELECT id, 'import' FROM new"""
)
def ingest_transaction(spark, folder):
    """A topic's documents before and after an import of its PubMed deliveries."""
    from lexifold.operators import ingest as G
    from lexifold.runtime import new_path
    from lexifold.sinks import state

    path = new_path(spark, "store")
    store = G.Store(spark, path)
    own = docs(spark, folder).filter(F.col("collection_id") == LEFT)
    state.publish(own.select(*[c.split()[0] for c in G.DOCUMENTS.split(", ")]), f"{path}/documents")
    deleted = load(spark, folder, "deleted_documents").filter(F.col("collection_id") == LEFT)
    state.append(deleted.select("collection_id", "article_id", "deleted_at"), f"{path}/deleted")
    before = store.documents.select("id")
    batch = _batch(spark, folder).filter(F.col("collection_id") == LEFT)
    if batch.limit(1).count():
        G.ingest(store, LEFT, "pubmed", "Gut peptides", lambda query, count, offset: batch)
    after = store.documents.select("id").join(before, "id", "left_anti")
    return before.withColumn("via", F.lit("held")).unionByName(after.withColumn("via", F.lit("import")))


@query(
    f"""WITH {_WORDS}, {Q.TOK}, spelt AS (SELECT collection_id, token AS word, count(*)::BIGINT AS n FROM tok WHERE token NOT IN ({Q.STOP}) AND regexp_matches(token, '^\\p{{L}}+$') GROUP BY ALL),
    vocabulary AS MATERIALIZED (SELECT s.collection_id, s.word, s.n FROM spelt s JOIN w2v USING (collection_id, word)), {_ASKED}, {_NEAR}, {_SUGGESTED}
    SELECT collection_id, word, CASE WHEN suggestion <> word THEN suggestion END AS suggestion FROM suggested s WHERE NOT EXISTS (SELECT 1 FROM w2v WHERE w2v.collection_id = s.collection_id AND w2v.word = s.word)"""
)
def w2v_hints(spark, folder):
    """For words without a vector, a near one that has one."""
    held = index(spark, folder)
    return E.hints(_asked(held.topics), E.vocabulary(docs(spark, folder)), held.words)


@query(f"SELECT '{_TERM}' AS term")
def query_term(spark, folder):
    return spark.createDataFrame([(Z.query_term(f"the {ONE} of", "D"),)], "term string")


@query(
    """SELECT collection_id AS id, title, coalesce(default_query, '') AS query, coalesce(source, 'pubmed') AS source, coalesce(document_count, 0)::INT AS count,
    CASE WHEN source_queries IS NULL THEN coalesce(source, 'pubmed') || '=' || coalesce(default_query, '') ELSE array_to_string(list_sort(list_transform(map_entries(source_queries), lambda e: e.key || '=' || coalesce(e.value, ''))), ' | ') END AS source_queries FROM collections"""
)
def collection_list(spark, folder):
    each = F.transform(F.map_entries("source_queries"), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit(""))))
    return C.listed(load(spark, folder, "collections")).withColumn("source_queries", F.array_join(F.array_sort(each), " | "))


@query(f"WITH {Q.DOCS} SELECT c.collection_id, count(d.id)::INT AS document_count FROM collections c LEFT JOIN docs d USING (collection_id) GROUP BY ALL")
def collection_recount(spark, folder):
    return C.recounted(load(spark, folder, "collections"), docs(spark, folder)).select("collection_id", "document_count")


@query("SELECT arg_min(collection_id, (created_at, collection_id)) AS collection_id FROM collections WHERE created_at IS NOT NULL")
def active_topic(spark, folder):
    return spark.createDataFrame([(C.active_topic(load(spark, folder, "collections"), "no such topic"),)], "collection_id string")


@query(f"WITH {Q.DOCS}, gone AS (SELECT min(id) AS id FROM docs WHERE collection_id = '{LEFT}') SELECT collection_id, id FROM docs WHERE NOT (collection_id = '{LEFT}' AND id = (SELECT id FROM gone))")
def document_deleted(spark, folder):
    """The held documents after one more is deleted."""
    from lexifold.operators import documents as D

    held = docs(spark, folder)
    first = held.filter(F.col("collection_id") == LEFT).agg(F.min("id")).first()[0]
    deleted = load(spark, folder, "deleted_documents").select("collection_id", "article_id", "deleted_at")
    more = C.deletion(held, LEFT, first).select(*deleted.columns) if first is not None else deleted.limit(0)
    return D.active(load(spark, folder, "articles"), deleted.unionByName(more)).select("collection_id", "id")


@query(f"WITH {Q.DOCS} SELECT collection_id, id FROM docs WHERE collection_id <> '{LEFT}'")
def collection_deleted(spark, folder):
    return C.without(docs(spark, folder), LEFT).select("collection_id", "id")
