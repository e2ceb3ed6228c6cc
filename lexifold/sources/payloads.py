"""PubMed records kept as JSON payloads, read as documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


SCHEMA = "collection_id string, id string, article_no bigint, title string, abstract string, body string, filename string, doi string, journal string"


def parsed(payload: str | None) -> dict | None:
    """The payload's object; None for null, broken and other payloads."""
    try:
        value = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(element) -> str | None:
    if isinstance(element, dict):
        element = element.get("#text")
    return element if isinstance(element, str) else None


def _tidy(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def _member(value, *names: str):
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def document(payload: str | None) -> dict | None:
    """Id, title, abstract, doi and journal of a payload; None without a PMID.

    Abstract parts stand on their own lines, each behind its label (or category)
    unless that is ``UNASSIGNED``.
    """
    record = parsed(payload)
    article = _member(record, "MedlineCitation", "Article")
    pmid = (_text(_member(record, "MedlineCitation", "PMID")) or "").strip()
    if not pmid:
        return None
    parts = []
    for part in _listed(_member(article, "Abstract", "AbstractText")):
        text = _tidy(_text(part))
        named = [part[k].strip() for k in ("@Label", "@NlmCategory") if isinstance(part.get(k), str) and part[k]] if isinstance(part, dict) else []
        label = named[0] if named else ""
        if text:
            parts.append(f"{label}: {text}" if label and label != "UNASSIGNED" else text)
    located = [x for x in _listed(_member(article, "ELocationID")) if isinstance(x, dict) and str(x.get("@EIdType", "")).lower() == "doi"]
    listed = [x for x in _listed(_member(record, "PubmedData", "ArticleIdList", "ArticleId")) if isinstance(x, dict) and str(x.get("@IdType", "")).lower() == "doi"]
    doi = next((t.strip() for x in (*located, *listed) if (t := _text(x)) and t.strip()), "")
    return {
        "id": f"PMID{pmid}",
        "title": _tidy(_text(_member(article, "ArticleTitle"))) or "(Untitled)",
        "abstract": "\n".join(parts),
        "doi": doi,
        "journal": _tidy(_text(_member(article, "Journal", "Title"))),
    }


def pubmed_documents(records: DataFrame) -> DataFrame:
    """Records with a PMID as documents; ``article_no`` is the record's number, the abstract may be empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, topic, filename, payload in zip(*(batch.column(c).to_pylist() for c in ("record_no", "collection_id", "filename", "payload"))):
                found = document(payload)
                if found:
                    rows.append((topic, found["id"], number, found["title"], found["abstract"], "", filename, found["doi"], found["journal"]))
            kinds = [pa.int64() if c == "article_no" else pa.string() for c in _COLUMNS]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_COLUMNS)

    return records.select("record_no", "collection_id", "filename", "payload").mapInArrow(task, SCHEMA)


_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
