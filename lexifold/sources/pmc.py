"""Full texts of PMC by PMID: id conversion, versions, checked files.

A handful of small answers, asked for on the driver.  ``get`` turns an address into
bytes; the default uses the network, stored answers work offline.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from urllib.parse import urlencode
from urllib.request import urlopen

from lexifold.sources.articles import MOST_BYTES, documents_of, parsed_xml

#: The services' addresses and bounds.
CONVERTER = "https://pmc.ncbi.nlm.nih.gov/tools/idconv/api/v1/articles/"
OPEN_DATA = "https://pmc-oa-opendata.s3.amazonaws.com/"
BUCKET = "s3://pmc-oa-opendata/"
MOST_VERSIONS, KEPT, KEPT_SECONDS = 20, 100, 300


def over_http(address: str) -> bytes:
    with urlopen(address, timeout=60) as answer:
        raw = answer.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError("the file is larger than 20 MB")
    return raw


def checked_pmcid(said: str) -> str:
    if not re.fullmatch(r"(?i)PMC[1-9]\d{0,11}", said.strip()):
        raise ValueError(f"no PMCID: {said}")
    return said.strip().upper()


class Archive:
    """PMC's open data; what it says of a version is kept for five minutes, of at most a hundred versions."""

    def __init__(self, get: Callable[[str], bytes] = over_http, clock: Callable[[], float] = time.monotonic) -> None:
        self.get, self.clock = get, clock
        self.kept: OrderedDict[tuple[str, int], tuple[float, dict]] = OrderedDict()

    def pmcid_of(self, pmid: str) -> str:
        """The PMCID of a PMID; a ValueError if it has none."""
        if not re.fullmatch(r"[1-9]\d{0,11}", pmid):
            raise ValueError(f"no PMID: {pmid}")
        match json.loads(self.get(f"{CONVERTER}?{urlencode({'ids': pmid, 'format': 'json'})}")):
            case {"records": [{"pmid": said, "pmcid": str(pmcid)}]} if str(said) == pmid:
                return checked_pmcid(pmcid)
        raise ValueError(f"PMID {pmid} has no full text in PMC")

    def versions(self, pmcid: str) -> list[int]:
        """Version numbers held, in order; a ValueError for none or too many."""
        pmcid = checked_pmcid(pmcid)
        listing = parsed_xml(self.get(f"{OPEN_DATA}?{urlencode({'list-type': 2, 'prefix': f'{pmcid}.', 'delimiter': '/', 'max-keys': 100})}"))
        named = (re.fullmatch(rf"{pmcid}\.([1-9]\d*)/", x.text or "") for x in listing.iterfind(".//CommonPrefixes/Prefix"))
        found = sorted({int(m.group(1)) for m in named if m})
        if not found or len(found) > MOST_VERSIONS or listing.findtext("IsTruncated") == "true":
            raise ValueError(f"{pmcid} has {'too many' if found else 'no'} versions")
        return found

    def described(self, pmcid: str, version: int) -> dict:
        """What the archive says of a version, with the address of its text and that text's checksum."""
        key = checked_pmcid(pmcid), int(version)
        at, said = self.kept.get(key, (float("-inf"), {}))
        if self.clock() - at < KEPT_SECONDS:
            return dict(said)
        name = f"{key[0]}.{key[1]}"
        said = json.loads(self.get(f"{OPEN_DATA}{name}/{name}.json"))
        if not isinstance(said, dict) or said.get("pmcid") != key[0] or str(said.get("version")) != str(key[1]):
            raise ValueError(f"what the archive says isn't about {name}")
        address = re.fullmatch(rf"{re.escape(BUCKET)}({re.escape(name)}/{re.escape(name)}\.xml)(?:\?md5=([0-9a-fA-F]{{32}}))?", said.get("xml_url") or "")
        if not address:
            raise ValueError(f"{name} has no full text")
        said |= {"address": OPEN_DATA + address.group(1), "md5": (address.group(2) or "").lower()}
        while len(self.kept) >= KEPT:
            self.kept.popitem(last=False)
        self.kept[key] = self.clock(), said
        return dict(said)

    def text(self, pmcid: str, version: int) -> tuple[bytes, dict]:
        """A version's file, checked, and its description with the file's SHA-256."""
        said = self.described(pmcid, version)
        raw = self.get(said["address"])
        if said["md5"] and hashlib.md5(raw).hexdigest() != said["md5"]:
            raise ValueError("the file isn't what its checksum says")
        if [d["id"] for d in documents_of(f"{said['pmcid']}.xml", raw)] != [said["pmcid"]]:
            raise ValueError("the file holds another article")
        return raw, said | {"sha256": hashlib.sha256(raw).hexdigest()}
