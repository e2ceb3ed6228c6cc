"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

_TERM = r"\p{Nd}+(?:\.\p{Nd}+)+|[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"



def _terms(text: str) -> str:
    return f"""
terms AS (
  SELECT article_no, replace(lower(t), 'ß', 'ss') AS term
  FROM (SELECT article_no, unnest(regexp_extract_all({text}, '{_TERM}')) AS t FROM articles WHERE text_state = 'parsed')
)"""



_P1 = f"""
WITH {_terms("abstract")},
n AS (SELECT count(DISTINCT article_no) AS n FROM terms),
counted AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT article_no)::BIGINT AS records FROM terms GROUP BY term),
banded AS (
  SELECT term, occurrences, records,
    CASE WHEN records < 3 THEN 'rare' WHEN records >= n / 8.0 THEN 'common' ELSE 'useful' END AS band
  FROM counted, n
)
"""

_P5 = f"""
WITH {_terms("concat_ws(chr(10), abstract, body)")},
n AS (SELECT count(DISTINCT article_no) AS n FROM terms),
df AS (SELECT term, count(DISTINCT article_no) AS records FROM terms GROUP BY term),
scored AS (
  SELECT article_no, term, round(count(*) * ln(any_value(n)::DOUBLE / any_value(records)), 6) AS score
  FROM terms JOIN df USING (term), n WHERE records >= 2 GROUP BY article_no, term
)
SELECT article_no, term FROM scored
QUALIFY row_number() OVER (PARTITION BY article_no ORDER BY score DESC, term) <= 3
"""

_P9 = """
WITH held AS (
  SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '\\p{L}'), '') AS s FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, length(s) AS n, unnest(range(1, length(s) - 38)) AS k, s FROM held WHERE length(s) >= 40
), marked AS (
  SELECT doc_id, n, k, row_number() OVER (PARTITION BY doc_id, substr(s, k, 40) ORDER BY k) > 1 AS again FROM runs
), covered AS (
  SELECT doc_id, n, k, least(40, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 40)) AS new FROM marked WHERE again
), shares AS (
  SELECT h.doc_id, length(s)::BIGINT AS n_letters, coalesce(sum(new), 0)::BIGINT AS n_repeated
  FROM (SELECT doc_id, coalesce(s, '') AS s FROM held UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NULL) h
  LEFT JOIN covered USING (doc_id) GROUP BY h.doc_id, length(s)
)
"""

_P3 = """
WITH held AS (
  SELECT article_no, array_to_string(regexp_extract_all(lower(coalesce(title, '') || abstract), '[\\p{L}\\p{N}]'), '') AS s
  FROM articles WHERE regexp_replace(abstract, '\\s', '', 'g') <> ''
), runs AS MATERIALIZED (
  SELECT DISTINCT article_no, hash(substr(s, k, 9)) AS run
  FROM (SELECT article_no, s, unnest(range(1, length(s) - 7)) AS k FROM held WHERE length(s) >= 9)
), sizes AS (SELECT article_no, count(*) AS n FROM runs GROUP BY article_no),
met AS (
  SELECT a.article_no AS a, b.article_no AS b, count(*) AS common
  FROM runs a JOIN runs b ON a.run = b.run AND a.article_no < b.article_no GROUP BY ALL
)
SELECT a AS article_no_a, b AS article_no_b
FROM met JOIN sizes x ON x.article_no = a JOIN sizes y ON y.article_no = b WHERE common >= 0.6 * (x.n + y.n - common)
"""

ORACLES: dict[str, str] = {
    "p3_found": _P3,
    "p1_terms": _P1 + "SELECT term, occurrences, records, band FROM banded",
    "p1_found": _P1 + "SELECT term, band FROM banded WHERE band <> 'useful'",
    "p5_found": _P5,
    "p9_shares": _P9 + "SELECT doc_id, n_letters, n_repeated, round(CASE WHEN n_letters > 0 THEN n_repeated / n_letters ELSE 0 END, 6)::DOUBLE AS share FROM shares",
    "p9_found": _P9 + "SELECT doc_id FROM shares WHERE n_letters > 0 AND n_repeated >= 0.3 * n_letters",
}
