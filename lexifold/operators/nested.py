"""Deeply nested semi-structured records to flat child tables.

A child table is named by the path to its elements.  Along the path a lone member
stands for a list of one, so optional lists and changing shapes come out alike.
A payload is read once, by Spark's own JSON reader into a variant; a child's path
through it gives one nested list column.  What reaches Python are that column's Arrow
buffers: rows are cut from its offsets, the parent indices of each level, the position
inside the parent, and a vectorised take of the record's keys; no record is walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """A child table: its name, the members on the way to its elements, and which of them can repeat.

    ``steps`` ends with the member that holds the elements; ``repeats`` names the
    members before it whose places make up an element's parent path.
    """

    name: str
    steps: tuple[str, ...]
    repeats: tuple[str, ...] = ()


PUBMED_CHILDREN = (
    Child("abstract_text", ("MedlineCitation", "Article", "Abstract", "AbstractText")),
    Child("other_abstract_text", ("MedlineCitation", "OtherAbstract", "AbstractText"), ("OtherAbstract",)),
    Child("article_id", ("PubmedData", "ArticleIdList", "ArticleId")),
    Child("reference_article_id", ("PubmedData", "ReferenceList", "Reference", "ArticleIdList", "ArticleId"), ("ReferenceList", "Reference")),
)


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def _listed(value: Column) -> Column:
    """A variant as an array of variants: nothing for null, a list's elements, else the value alone."""
    none = F.array().cast("array<variant>")
    return F.when(value.isNull() | F.is_variant_null(value), none).otherwise(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def _text(element: Column) -> Column:
    """A string, or an object's ``#text`` if that is one."""
    inner = _member(element, "#text")
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(string(element), string(inner))


def nested(value: Column, steps: tuple[str, ...], repeats: tuple[str, ...]) -> Column:
    """The elements' texts below a variant as nested arrays, one level per repeating member and one for the elements."""
    member, rest = steps[0], steps[1:]
    found = _listed(_member(value, member))
    if not rest:
        return F.transform(found, _text)
    below = F.transform(found, lambda v: nested(v, rest, repeats))
    return below if member in repeats else F.flatten(below)  # a list where one was expected: its parts follow each other


def flattened(keys: pa.Array, column: pa.Array, levels: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Keys, parent paths, positions and texts of the innermost elements of a nested list column."""
    root = pa.array(np.arange(len(column)), pa.int64())
    places: list[pa.Array] = []
    for _ in range(levels):
        parent = pc.list_parent_indices(column)
        offsets = column.offsets.cast(pa.int64())
        within = pc.subtract(pa.array(np.arange(len(parent)), pa.int64()), pc.subtract(offsets.take(parent), offsets[0]))
        root, places = root.take(parent), [*(p.take(parent) for p in places), within]
        column = column.flatten()
    *above, position = places
    path = pc.binary_join_element_wise(*(p.cast(pa.string()) for p in above), ".") if above else pa.array([""] * len(position), pa.string())
    return keys.take(root), path, position, column


def flatten_records(records: DataFrame, key: str, payload: str, children: tuple[Child, ...] = PUBMED_CHILDREN, rows: int = 4000) -> DataFrame:
    """One row per element with text: key, child, parent_path, pos, text.

    An element is a string or an object with a string ``#text``; blank texts give no
    row.  ``pos`` counts from 0 in the element's list and counts elements without
    text; ``parent_path`` holds the places of the repeating members, joined by dots.
    Where a member that doesn't repeat comes as a list of several, its parts' elements
    follow each other as one list.  A payload that is null, empty, broken (a repeated
    name in one object among it) or no JSON object gives no rows.  Repeated records
    come out each, with their key; other columns are ignored; an empty table gives an
    empty result.  ``rows`` bounds a task's batch.
    """
    names = [f"_{k}" for k in range(len(children))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                for child, name in zip(children, names):
                    keys, path, position, text = flattened(batch.column("_key"), batch.column(name), len(child.repeats) + 1)
                    filled = pc.not_equal(pc.fill_null(pc.utf8_trim_whitespace(text), ""), "")
                    out = [keys, pa.array([child.name] * len(keys), pa.string()), path, position, text]
                    yield pa.record_batch([x.filter(filled) for x in out], names=[key, "child", "parent_path", "pos", "text"])

    kind = records.schema[key].dataType.simpleString()
    read = records.select(F.col(key).alias("_key"), F.try_parse_json(F.col(payload)).alias("_payload"))
    columns = [nested(F.col("_payload"), c.steps, c.repeats).alias(n) for c, n in zip(children, names)]
    # Only records that are read go on; the reading isn't repeated for each path.
    listed = read.filter(F.col("_payload").isNotNull()).select("_key", *columns)
    return listed.mapInArrow(task, f"`{key}` {kind}, child string, parent_path string, pos bigint, text string")
