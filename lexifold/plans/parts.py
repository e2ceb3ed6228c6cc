"""Building blocks of the comparison SQL: documents, tokens, stems, sentences, scores.

Each starts from the Parquet tables and repeats an operator's definition in
DuckDB's terms.  Nothing is taken from the operators' code: patterns, word lists and
Porter's tables stand here once more, so that an error in either shows.
"""

from __future__ import annotations

#: Tokens, white space, line ends as RE2 patterns; stop words; abbreviations.
TOKEN = r"\p{Nd}+(?:\.\p{Nd}+)+|[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
STOP = """'a', 'about', 'also', 'an', 'and', 'are', 'as', 'at', 'be', 'been', 'being', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'for', 'from', 'had', 'has', 'have',
 'he', 'her', 'his', 'how', 'if', 'in', 'into', 'is', 'it', 'its', 'may', 'might', 'no', 'not', 'of', 'on', 'or', 'our', 'she', 'should', 'such', 'than', 'that', 'the', 'their',
 'then', 'these', 'they', 'this', 'those', 'to', 'use', 'used', 'using', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'who', 'whom', 'will', 'with', 'would', 'you', 'your'"""
SHORTENED = r"approx|Dr|e\.g|Eq|Eqs|et\s+al|Fig|Figs|i\.e|Mr|Mrs|Ms|No|Prof|vol|vs"
KEPT, CUT = "\ue000", "\ue001"
#: Porter's measures as patterns, and suffixes with what stands in their place.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M_1, M_IS_1, M_2, VOWEL, SHORT = f"^(?:{C})?{V}{C}", f"^(?:{C})?{V}{C}(?:{V})?$", f"^(?:{C})?{V}{C}{V}{C}", f"^(?:{C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$"
SECOND = """ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al,
 iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"""
THIRD = "icate ic, ative, alize al, iciti ic, ical ic, ful, ness"
FOURTH = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou".split()


def _pairs(table: str) -> list[tuple[str, str]]:
    return [tuple((entry.split() + [""])[:2]) for entry in table.split(",")]


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


DOCS = f"""
uniform AS (
  SELECT collection_id, article_id AS id, article_no, coalesce(abstract, '') AS abstract, coalesce(body, '') AS body,
    coalesce(filename, '') AS filename, coalesce(doi, '') AS doi, coalesce(journal, '') AS journal,
    CASE WHEN {strip("coalesce(title, '')")} = '' THEN '(Untitled)' ELSE title END AS title
  FROM articles
),
docs AS MATERIALIZED (
  SELECT * FROM uniform u
  WHERE NOT EXISTS (SELECT 1 FROM deleted_documents d WHERE d.collection_id = u.collection_id AND d.article_id = u.id)
  QUALIFY row_number() OVER (PARTITION BY collection_id, id ORDER BY article_no) = 1
)"""

NUMBERS = """
stored AS (SELECT collection_id, article_id AS id, any_value(doc_number) AS doc_number FROM document_numbers GROUP BY ALL),
top AS (SELECT collection_id, max(doc_number) AS highest FROM document_numbers GROUP BY ALL),
places AS (
  SELECT d.collection_id, d.id, coalesce(doc_number, coalesce(highest, 0)
    + row_number() OVER (PARTITION BY d.collection_id, doc_number IS NULL ORDER BY article_no)) AS place
  FROM docs d LEFT JOIN stored USING (collection_id, id) LEFT JOIN top ON top.collection_id = d.collection_id
),
numbers AS MATERIALIZED (
  SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id ORDER BY place, id)::BIGINT AS number FROM places
)"""


def tokens(region: str, column: str) -> str:
    return f"""SELECT collection_id, id, article_no, '{region}' AS region, pos, {fold("t")} AS token FROM (
      SELECT collection_id, id, article_no, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT *, regexp_extract_all({column}, '{TOKEN}') AS l FROM docs))"""


TOK = f"""
tok AS MATERIALIZED (
    {tokens("abstract", "abstract")}
    UNION ALL
    {tokens("body", "body")}
)"""


def _m(pattern: str, base: str) -> str:
    return f"regexp_matches({base}, '{pattern}')"


def _table(table, word: str, test: str) -> str:
    cases = " ".join(
        f"WHEN {word} LIKE '%{s}' THEN CASE WHEN {_m(test, f'left({word}, -{len(s)})')} THEN left({word}, -{len(s)}) || '{r}' ELSE {word} END" for s, r in table
    )
    return f"CASE {cases} ELSE {word} END"


def stems(source: str) -> str:
    """CTEs ending in stemmed(token, stem) for the distinct tokens of ``source``."""
    step_4 = " ".join(
        f"WHEN w LIKE '%{s}' THEN CASE WHEN {_m(M_2, f'left(w, -{len(s)})')}"
        + (" AND regexp_matches(left(w, -3), '[st]$')" if s == "ion" else "")
        + f" THEN left(w, -{len(s)}) ELSE w END"
        for s in FOURTH
    )
    last = "substr(base, length(base), 1)"
    return f"""
vocab AS MATERIALIZED (SELECT DISTINCT token FROM {source}),
p0 AS (SELECT token, token AS w FROM vocab WHERE length(token) > 2 AND regexp_matches(token, '^[a-z]+$')),
p1 AS (SELECT token, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, -1) ELSE w END AS w FROM p0),
p2 AS (SELECT token, w, CASE WHEN w LIKE '%eed' THEN NULL
    WHEN w LIKE '%ed' THEN CASE WHEN {_m(VOWEL, "left(w, -2)")} THEN left(w, -2) END
    WHEN w LIKE '%ing' THEN CASE WHEN {_m(VOWEL, "left(w, -3)")} THEN left(w, -3) END END AS base FROM p1),
p3 AS (SELECT token, CASE
    WHEN w LIKE '%eed' THEN CASE WHEN {_m(M_1, "left(w, -3)")} THEN left(w, -1) ELSE w END
    WHEN base IS NULL THEN w
    WHEN base LIKE '%at' OR base LIKE '%bl' OR base LIKE '%iz' THEN base || 'e'
    WHEN length(base) > 1 AND {last} = substr(base, length(base) - 1, 1) AND NOT contains('aeiouylsz', {last}) THEN left(base, -1)
    WHEN {_m(M_IS_1, "base")} AND {_m(SHORT, "base")} THEN base || 'e'
    ELSE base END AS w FROM p2),
p4 AS (SELECT token, CASE WHEN w LIKE '%y' AND {_m(VOWEL, "left(w, -1)")} THEN left(w, -1) || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT token, {_table(_pairs(SECOND), "w", M_1)} AS w FROM p4),
p6 AS (SELECT token, {_table(_pairs(THIRD), "w", M_1)} AS w FROM p5),
p7 AS (SELECT token, CASE {step_4} ELSE w END AS w FROM p6),
p8 AS (SELECT token, CASE WHEN w LIKE '%e' AND ({_m(M_2, "left(w, -1)")}
    OR {_m(M_IS_1, "left(w, -1)")} AND NOT {_m(SHORT, "left(w, -1)")}) THEN left(w, -1) ELSE w END AS w FROM p7),
p9 AS (SELECT token, CASE WHEN w LIKE '%ll' AND {_m(M_2, "w")} THEN left(w, -1) ELSE w END AS stem FROM p8),
stemmed AS MATERIALIZED (SELECT token, coalesce(stem, token) AS stem FROM vocab LEFT JOIN p9 USING (token))"""


TERMS = f"""{DOCS}, {TOK}, {stems("tok")},
trm AS MATERIALIZED (SELECT tok.*, stem FROM tok JOIN stemmed USING (token) WHERE token NOT IN ({STOP}))"""


def sentences(column: str) -> str:
    """List expression of a text's sentences."""
    before = r"(^|[^\p{L}\p{N}_])"
    ends = f".!?。！？{KEPT}"
    x = strip("line")
    x = f"regexp_replace({x}, '{before}((?i:{SHORTENED}))\\.', '\\1\\2{KEPT}', 'g')"
    for _ in range(2):  # a match takes in what follows it
        x = f"regexp_replace({x}, '{before}([A-Z])\\.({BLANK}+[A-Z][a-z])', '\\1\\2{KEPT}\\3', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '{before}((?:[A-Za-z][.{KEPT}])+[A-Za-z])\\.({BLANK}+[a-z])', '\\1\\2{KEPT}\\3', 'g')"
    x = f"regexp_replace({x}, '([{ends}]*[.!?。！？][{ends}]*[\"''”’)\\]]*)({BLANK}|$)', '\\1{CUT}\\2', 'g')"
    each = f"list_transform(string_split({x}, '{CUT}'), lambda s: replace({strip('s')}, '{KEPT}', '.'))"
    return f"list_filter(flatten(list_transform(regexp_split_to_array({column}, '{LINE_END}'), lambda line: {each})), lambda s: s <> '')"


def condition(c: str) -> str:
    """CTEs ending in zt(collection_id, id, pos, term): the abstracts' tokens under a condition."""
    if c == "A":
        return f"""{DOCS}, zt AS MATERIALIZED (
          SELECT collection_id, id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (
            SELECT collection_id, id, list_filter(regexp_split_to_array({fold("abstract")}, '{BLANK}+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) AS l FROM docs))"""
    if c == "B":
        return f"{DOCS}, zt AS MATERIALIZED (SELECT collection_id, id, pos, token AS term FROM ({tokens('abstract', 'abstract')}))"
    if c == "C":
        return f"{DOCS}, zt AS MATERIALIZED (SELECT collection_id, id, pos, token AS term FROM ({tokens('abstract', 'abstract')}) WHERE token NOT IN ({STOP}))"
    return f"{TERMS}, zt AS MATERIALIZED (SELECT collection_id, id, pos, stem AS term FROM trm WHERE region = 'abstract')"


def frequencies(c: str) -> str:
    return f"""{condition(c)},
freq AS MATERIALIZED (SELECT collection_id, term, count(*)::BIGINT AS cf, count(DISTINCT id)::BIGINT AS df FROM zt GROUP BY ALL),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY cf DESC, term)::BIGINT AS rank FROM freq),
sizes AS (SELECT collection_id, count(*)::BIGINT AS documents FROM docs GROUP BY ALL)"""


def fit(source: str, by: str) -> str:
    """Select of the least-squares columns over ``source`` grouped by ``by``."""
    return f"""SELECT {by},
  round(CASE WHEN n >= 2 AND sxx > 0 THEN slope ELSE 0 END, 6)::DOUBLE AS slope,
  round(CASE WHEN n >= 2 AND sxx > 0 THEN intercept ELSE 0 END, 6)::DOUBLE AS intercept,
  round(CASE WHEN n >= 2 AND sxx > 0 THEN -slope ELSE 0 END, 6)::DOUBLE AS exponent,
  round(CASE WHEN n >= 2 AND sxx > 0 AND syy > 1e-12 THEN 1 - greatest(0, syy - slope * sxy) / syy ELSE 0 END, 6)::DOUBLE AS r_squared,
  round(CASE WHEN n >= 2 AND sxx > 0 THEN sqrt(greatest(0, syy - slope * sxy) / n) ELSE 0 END, 6)::DOUBLE AS rmse
FROM (SELECT {by}, count(*) AS n, regr_slope(log10(cf), log10(rank)) AS slope, regr_intercept(log10(cf), log10(rank)) AS intercept,
    regr_sxx(log10(cf), log10(rank)) AS sxx, regr_sxy(log10(cf), log10(rank)) AS sxy, regr_syy(log10(cf), log10(rank)) AS syy
  FROM {source} GROUP BY {by})"""


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words) or "NULL"


def scored(terms: list[str]) -> str:
    """CTEs ending in scored(collection_id, id, score, matched): BM25 of every document."""
    return f"""{TERMS},
tf AS (SELECT collection_id, id, stem, count(*) AS tf FROM trm WHERE stem IN ({listed(terms)}) GROUP BY ALL),
dl AS MATERIALIZED (SELECT d.collection_id, d.id, count(t.stem)::BIGINT AS length FROM docs d LEFT JOIN trm t USING (collection_id, id) GROUP BY ALL),
topic AS (SELECT collection_id, count(*) AS n, avg(length) AS avg_length FROM dl GROUP BY ALL),
df AS (SELECT collection_id, stem, count(*) AS df FROM tf GROUP BY ALL),
scored AS MATERIALIZED (
  SELECT dl.collection_id, dl.id, count(tf.stem) AS matched,
    coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / greatest(avg_length, 1)))), 0) AS score
  FROM dl JOIN topic USING (collection_id) LEFT JOIN tf USING (collection_id, id) LEFT JOIN df ON df.collection_id = tf.collection_id AND df.stem = tf.stem
  GROUP BY ALL
)"""


def hits(terms: list[str], mode: str, phrase: list[str] | None = None, doc_id: str | None = None) -> str:
    """CTEs ending in hits(collection_id, id, score, rank)."""
    if mode == "PHRASE":
        where = "true" if phrase else "false"
        lines = f"""phrased AS (
  SELECT DISTINCT collection_id, id FROM (
    SELECT collection_id, id, line_no, ' ' || string_agg(stem, ' ' ORDER BY pos) || ' ' AS s FROM (
      SELECT collection_id, id, line_no, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (
        SELECT collection_id, id, line_no, regexp_extract_all(line, '{TOKEN}') AS l FROM (
          SELECT collection_id, id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
          FROM (SELECT collection_id, id, regexp_split_to_array(abstract || chr(10) || body, '{LINE_END}') AS ls FROM docs))))
    JOIN stemmed ON token = {fold("t")} GROUP BY ALL)
  WHERE contains(s, ' {" ".join(phrase or [])} ')
),"""
        source = "scored JOIN phrased USING (collection_id, id)"
    else:
        lines, source = "", "scored"
        where = "false" if not terms else f"matched = {len(terms)}" if mode == "AND" else "matched > 0"
    only = f" AND id = '{doc_id}'" if doc_id else ""
    return f"""{scored(terms)}, {lines}
hits AS MATERIALIZED (
  SELECT collection_id, id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY collection_id ORDER BY round(score, 9) DESC, id)::BIGINT AS rank
  FROM {source} WHERE {where}{only}
)"""


COUNTS = f"""
counts AS MATERIALIZED (
  SELECT d.collection_id, d.id, length(abstract)::BIGINT AS characters, length(regexp_replace(abstract, '{BLANK}', '', 'g'))::BIGINT AS characters_no_space,
    coalesce(words, 0)::BIGINT AS words, len({sentences("abstract")})::BIGINT AS sentences, coalesce(indexed_terms, 0)::BIGINT AS indexed_terms,
    coalesce(unique_terms, 0)::BIGINT AS unique_terms
  FROM docs d
  LEFT JOIN (SELECT collection_id, id, count(*) AS words FROM tok WHERE region = 'abstract' GROUP BY ALL) USING (collection_id, id)
  LEFT JOIN (SELECT collection_id, id, count(*) AS indexed_terms, count(DISTINCT stem) AS unique_terms FROM trm WHERE region = 'abstract' GROUP BY ALL) USING (collection_id, id)
)"""
