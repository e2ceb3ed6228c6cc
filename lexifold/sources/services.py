"""Literature services as a Spark data source.

``spark.dataSource.register(LiteratureSource)`` and
``spark.read.format("literature").option("service", "pubmed").option("query", ...)``.
A service is asked by one partition, call after call, as it limits how many may come in a
second.  The network stands behind a transport, a function named by the option
``transport`` as ``module:function`` that turns (endpoint, parameters) into bytes; any
that reads stored answers works offline.

Every record a service returns is a row, those without abstract among them, so
requested, returned and usable records can be counted; an answer without records is
no rows.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexifold.sources.articles import COLUMNS, arxiv_id, documents_of

BATCH = 200
#: The endpoints' addresses; each service's pause in seconds between calls, pause after a failure, and attempts.
ENDPOINTS = {
    "esearch": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi",
    "efetch": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi",
    "arxiv": "https://export.arxiv.org/api/query",
}
PACE = {"pubmed": (0.4, 1.5, 4), "arxiv": (3.0, 3.0, 3)}


def checked(query: str, count: int, offset: int) -> None:
    if not 1 <= len(query.strip()) <= 300:
        raise ValueError("a query has 1 to 300 characters")
    if not (10 <= count <= 1000 and 0 <= offset <= 10_000):
        raise ValueError("10 to 1,000 records from an offset of 0 to 10,000")


def checked_ids(service: str, said: str) -> list[str]:
    """Distinct ids in order; a ValueError for an invalid one, for none, and for more than 200."""
    pieces = [p for p in re.split(r"[\s,;，；]+", said) if p]
    if service == "pubmed":
        pieces = [re.sub(r"(?i)^PMID[:#]?(?=\d)", "", p) for p in pieces]
        bad = [p for p in pieces if not re.fullmatch(r"[1-9]\d{0,11}", p)]
        if bad:
            raise ValueError(f"no PMID: {bad[0]}")
    else:
        pieces = [arxiv_id(p) for p in pieces]
    distinct = list(dict.fromkeys(pieces))
    if not 1 <= len(distinct) <= BATCH:
        raise ValueError(f"1 to {BATCH} different ids")
    return distinct


def over_http(endpoint: str, parameters: dict[str, str]) -> bytes:
    """The default transport: one call, tried again after failures that may pass."""
    _, wait, attempts = PACE["arxiv" if endpoint == "arxiv" else "pubmed"]
    last: Exception = OSError("no attempt")
    for attempt in range(1, attempts + 1):
        try:
            with urlopen(Request(f"{ENDPOINTS[endpoint]}?{urlencode(parameters)}"), timeout=60) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise
            last = e
        except OSError as e:
            last = e
        if attempt < attempts:
            time.sleep(wait * attempt)
    raise last


@dataclass
class Calls(InputPartition):
    """The calls of a read, in order."""

    calls: list[tuple[str, dict[str, str]]]

    def __init__(self, calls: list[tuple[str, dict[str, str]]]) -> None:
        super().__init__(None)
        self.calls = calls


class LiteratureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.service = options.get("service", "pubmed")
        if self.service not in PACE:
            raise ValueError(f"unknown service {self.service!r}")
        self.transport = options.get("transport", f"{__name__}:over_http")
        self.pause = float(options.get("pause", PACE[self.service][0]))
        self.ids = checked_ids(self.service, options["ids"]) if "ids" in options else []
        self.query, self.count, self.offset = options.get("query", "").strip(), int(options.get("count", 500)), int(options.get("offset", 0))
        if not self.ids:
            checked(self.query, self.count, self.offset)

    def _call(self, endpoint: str, parameters: dict[str, str]) -> bytes:
        module, _, name = self.transport.partition(":")
        transport: Callable[[str, dict[str, str]], bytes] = getattr(importlib.import_module(module), name)
        return transport(endpoint, parameters)

    def _found(self) -> list[str]:
        """Ids of a PubMed query's records with abstracts, most relevant first."""
        asked = {"db": "pubmed", "term": f"({self.query}) AND hasabstract[text]", "retmode": "json", "retmax": str(self.count), "retstart": str(self.offset), "sort": "relevance"}
        try:
            return [str(i) for i in json.loads(self._call("esearch", asked))["esearchresult"]["idlist"]]
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"no answer to a search: {e}") from e

    def partitions(self) -> list[Calls]:
        if self.service == "arxiv":
            if self.ids:
                return [Calls([("arxiv", {"id_list": ",".join(self.ids), "start": "0", "max_results": str(len(self.ids))})])]
            starts = range(self.offset, self.offset + self.count, BATCH)
            return [Calls([("arxiv", {"search_query": self.query, "start": str(s), "max_results": str(min(BATCH, self.offset + self.count - s))}) for s in starts])]
        ids = self.ids or self._found()
        return [Calls([("efetch", {"db": "pubmed", "id": ",".join(ids[k : k + BATCH]), "retmode": "xml"}) for k in range(0, len(ids), BATCH)])]

    def read(self, partition: Calls) -> Iterator[tuple]:
        for number, (endpoint, parameters) in enumerate(partition.calls):
            if number or endpoint == "efetch" and not self.ids:  # a search went before
                time.sleep(self.pause)
            for row in documents_of(f"{self.service}.xml", self._call(endpoint, parameters), needs=("id",)):
                yield tuple(row[c] for c in COLUMNS)


class LiteratureSource(DataSource):
    """PubMed and arXiv by query or by ids."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> LiteratureReader:
        return LiteratureReader(dict(self.options))
