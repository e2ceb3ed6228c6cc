"""Queries over nested source records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexifold.operators.nested import flatten_records
from lexifold.runtime import load


def p4_children(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_records(load(spark, folder, "pubmed_records"), "record_no", "payload")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_children(spark, folder).drop("text")


QUERIES = {f.__name__: f for f in (p4_found, p4_children)}

_CHILDREN = """
WITH ok AS MATERIALIZED (
  SELECT record_no, payload::JSON AS p FROM pubmed_records
  WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END
), top AS MATERIALIZED (
  SELECT record_no, 'abstract_text' AS child, '' AS parent_path, p->'$.MedlineCitation.Article.Abstract.AbstractText' AS v FROM ok
  UNION ALL
  SELECT record_no, 'article_id', '', p->'$.PubmedData.ArticleIdList.ArticleId' FROM ok
), other AS MATERIALIZED (
  SELECT record_no, p->'$.MedlineCitation.OtherAbstract' AS v FROM ok
), other_each AS MATERIALIZED (
  SELECT record_no, i AS i, CASE WHEN json_type(v) = 'ARRAY' THEN v->(i::INT) ELSE v END AS v
  FROM (SELECT record_no, v, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::INT ELSE 1 END)) AS i FROM other WHERE v IS NOT NULL)
), lists AS MATERIALIZED (
  SELECT record_no, p->'$.PubmedData.ReferenceList' AS v FROM ok
), lists_each AS MATERIALIZED (
  SELECT record_no, i, CASE WHEN json_type(v) = 'ARRAY' THEN v->(i::INT) ELSE v END->'$.Reference' AS v
  FROM (SELECT record_no, v, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::INT ELSE 1 END)) AS i FROM lists WHERE v IS NOT NULL)
), refs_each AS MATERIALIZED (
  SELECT record_no, i, j, CASE WHEN json_type(v) = 'ARRAY' THEN v->(j::INT) ELSE v END->'$.ArticleIdList.ArticleId' AS v
  FROM (SELECT record_no, i, v, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::INT ELSE 1 END)) AS j FROM lists_each WHERE v IS NOT NULL)
), held AS MATERIALIZED (
  SELECT * FROM top
  UNION ALL
  SELECT record_no, 'other_abstract_text', i::VARCHAR, v->'$.AbstractText' FROM other_each
  UNION ALL
  SELECT record_no, 'reference_article_id', i::VARCHAR || '.' || j::VARCHAR, v FROM refs_each
), elements AS MATERIALIZED (
  SELECT record_no, child, parent_path, k::BIGINT AS pos, CASE WHEN json_type(v) = 'ARRAY' THEN v->(k::INT) ELSE v END AS e
  FROM (SELECT *, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::INT ELSE 1 END)) AS k FROM held WHERE v IS NOT NULL)
), texts AS (
  SELECT record_no, child, parent_path, pos,
    CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$'
         WHEN json_type(e) = 'OBJECT' AND json_type(e->'$."#text"') = 'VARCHAR' THEN e->>'$."#text"' END AS text
  FROM elements
)
SELECT {columns} FROM texts WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''
"""

ORACLES = {
    "p4_found": _CHILDREN.format(columns="record_no, child, parent_path, pos"),
    "p4_children": _CHILDREN.format(columns="record_no, child, parent_path, pos, text"),
}
