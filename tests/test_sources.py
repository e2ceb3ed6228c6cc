import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from lexifold.operators import ingest
from lexifold.operators.nested import Child, flatten_records
from lexifold.sinks.csv import result_rows, write
from lexifold.sinks import state
from lexifold.sinks.state import append, held, replace
from lexifold.sources import articles, payloads, pmc, services
from lexifold.streaming.landing import follow

PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A <i>ti</i>tle</ArticleTitle>
<Abstract><AbstractText Label="AIM">inter<i>leukin</i><xref>10</xref>rose</AbstractText><AbstractText NlmCategory="UNASSIGNED">Second.</AbstractText></Abstract>
<Journal><Title>J</Title></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
JATS = """<article xmlns="u"><front><journal-meta><journal-title-group><journal-title>K</journal-title></journal-title-group></journal-meta><article-meta>
<article-id pub-id-type="pmc">55</article-id><title-group><article-title>Full</article-title></title-group><abstract><title>Head</title><p>Short.</p></abstract></article-meta></front>
<body><sec><title>Gone</title><p>First<ref-list><p>hidden</p></ref-list> tail.</p><p>Second.</p></sec></body></article>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2010.11929v2</id><title>T
 wo</title><summary> Some
 text </summary></entry><entry><id>http://arxiv.org/abs/2010.11929v3</id><summary>again</summary></entry><entry><id>http://arxiv.org/abs/hep-th/9901001</id><summary> </summary></entry></feed>"""
JSON = '﻿{"documents": [{"pmid": 9, "title": "", "abstract": "ab"}, {"pmid": "pmid10", "abstract": "cd"}, 3, {"pmid": 11}]}'
BAD = '<!DOCTYPE a [<!ENTITY x "y">]><article/>'


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.xml": PUBMED, "b.nxml": JATS, "c.XML": ATOM, "pubmed_d.json": JSON, "e.xml": BAD, "f.xml": "<x>", "g.metadata.json": "{}", "z.xml": PUBMED}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_files(spark, folder):
    found, failed = articles.loaded(articles.read(articles.files(spark, folder)))
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"PMID7", "PMC55", "ARXIV:2010.11929", "PMID9", "pmid10"}
    assert rows["PMID7"].abstract == "AIM: interleukin 10 rose\nSecond." and rows["PMID7"].title == "A title" and rows["PMID7"].doi == "10.1/x"
    assert rows["PMC55"].abstract == "Short." and rows["PMC55"].body == "First tail.\nSecond." and rows["PMC55"].journal == "K"
    assert rows["ARXIV:2010.11929"].title == "T wo" and rows["ARXIV:2010.11929"].abstract == "Some text"
    assert rows["PMID9"].title == "(Untitled)"
    assert sorted(r.filename for r in failed.collect()) == ["e.xml", "f.xml", "z.xml"]


def test_no_body():
    with pytest.raises(ValueError):
        articles.documents_of("x.xml", JATS.replace("<p>First", "<x>").replace("</p><p>Second.</p>", "</x>").split("<body>")[0].encode() + b"</article>")
    with pytest.raises(ValueError):
        articles.documents_of("x.xml", b"x" * (articles.MOST_BYTES + 1))


def test_stream(spark, folder, tmp_path):
    out = tmp_path / "out"
    paths = [str(out / n) for n in ("documents", "deleted", "errors", "state")]
    append(spark.createDataFrame([("PMID9",)], "id string"), paths[1])
    for _ in range(2):
        follow(spark, folder, *paths).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(paths[0]).collect()) == ["ARXIV:2010.11929", "PMC55", "PMID7", "pmid10"]
    (tmp_path / "late.xml").write_text(PUBMED.replace("<PMID>7", "<PMID>77"))
    follow(spark, folder, *paths).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 5


CALLS = []


def stored(endpoint, parameters):
    """Answers of a small PubMed: every record has its id, every tenth no abstract."""
    CALLS.append((endpoint, parameters))
    if endpoint == "esearch":
        assert {k: v for k, v in parameters.items() if k not in ("retmax", "retstart")} == {"db": "pubmed", "term": "(sleep) AND hasabstract[text]", "retmode": "json", "sort": "relevance"}
        first, n = int(parameters["retstart"]), int(parameters["retmax"])
        return json.dumps({"esearchresult": {"count": "430", "idlist": [str(k) for k in range(1000 + first, min(1430, 1000 + first + n))]}}).encode()
    assert endpoint == "efetch" and set(parameters) == {"db", "id", "retmode"} and parameters["db"] == "pubmed" and parameters["retmode"] == "xml"
    ids = parameters["id"].split(",")
    assert 1 <= len(ids) <= 200
    article = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T{0}</ArticleTitle>{1}</Article></MedlineCitation></PubmedArticle>"
    found = [article.format(i, "" if int(i) % 10 == 0 else f"<Abstract><AbstractText>about {i}</AbstractText></Abstract>") for i in ids if int(i) < 5000]
    return f"<PubmedArticleSet>{''.join(found)}</PubmedArticleSet>".encode()


def stored_arxiv(endpoint, parameters):
    CALLS.append((endpoint, parameters))
    assert endpoint == "arxiv"
    return ATOM.encode()


def test_service(spark):
    transport = {"transport": f"{__name__}:stored", "pause": "0"}
    CALLS.clear()
    reader = services.LiteratureReader({"query": " sleep ", "count": "430", "offset": "0"} | transport)
    (partition,) = reader.partitions()
    rows = list(reader.read(partition))
    assert [c[0] for c in CALLS] == ["esearch", "efetch", "efetch", "efetch"] and [len(p["id"].split(",")) for e, p in CALLS if e == "efetch"] == [200, 200, 30]
    assert len(rows) == 430 and rows[1][:3] == ("PMID1001", "T1001", "about 1001") and rows[0][2] == ""
    CALLS.clear()
    reader = services.LiteratureReader({"ids": "PMID:7; 8,7，9000"} | transport)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["PMID7", "PMID8"] and CALLS == [("efetch", {"db": "pubmed", "id": "7,8,9000", "retmode": "xml"})]
    reader = services.LiteratureReader({"ids": "9000"} | transport)
    assert [r for p in reader.partitions() for r in reader.read(p)] == []
    arxiv = {"service": "arxiv", "transport": f"{__name__}:stored_arxiv", "pause": "0"}
    CALLS.clear()
    reader = services.LiteratureReader({"query": "all:sleep", "count": "450", "offset": "10"} | arxiv)
    (partition,) = reader.partitions()  # one, so that calls follow each other
    assert [r[0] for r in reader.read(partition) if r[2]] == ["ARXIV:2010.11929"] * 3
    assert CALLS == [("arxiv", {"search_query": "all:sleep", "start": s, "max_results": n}) for s, n in (("10", "200"), ("210", "200"), ("410", "50"))]
    reader = services.LiteratureReader({"ids": "2010.11929v3 hep-th/9901001"} | arxiv)
    assert reader.partitions()[0].calls == [("arxiv", {"id_list": "2010.11929,hep-th/9901001", "start": "0", "max_results": "2"})]
    many = ",".join(map(str, range(1, 202)))
    for bad in ({"query": ""}, {"query": "x", "count": "5"}, {"query": "x", "offset": "10001"}, {"service": "y", "ids": "1"}, {"ids": "1,xyz"}, {"ids": " "}, {"ids": many}, {"ids": "x", "service": "arxiv"}):
        with pytest.raises(ValueError):
            services.LiteratureReader(bad)
    spark.dataSource.register(services.LiteratureSource)
    assert spark.read.format("literature").options(ids="1,2", **transport).load().columns == list(articles.COLUMNS)


def test_retries(monkeypatch):
    waited, answers = [], [services.HTTPError("u", 503, "busy", {}, None), OSError("x"), io.BytesIO(b"ok")]

    def call(request, timeout):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    monkeypatch.setattr(services, "urlopen", call)
    monkeypatch.setattr(services.time, "sleep", waited.append)
    assert services.over_http("efetch", {}) == b"ok" and waited == [1.5, 3.0]
    answers[:] = [services.HTTPError("u", 404, "none", {}, None)]
    with pytest.raises(services.HTTPError):
        services.over_http("efetch", {})


def test_ingest(spark, tmp_path, monkeypatch):
    store = ingest.Store(spark, str(tmp_path / "store"))
    asked = []

    def fetch(query, count, offset):
        asked.append((query, count, offset))
        rows = [(f"PMID{k}", "t", "" if k % 5 == 0 else "text") for k in range(1 + offset, 11 + offset)]
        return spark.createDataFrame(rows + rows[1:2], "id string, title string, abstract string")

    state.append(spark.createDataFrame([("x", "PMID3", None)], ingest.DELETED), f"{store.folder}/deleted")
    assert ingest.ingest(store, "x", "pubmed", " Sleep ", fetch, 10) == {"requested": 10, "downloaded": 11, "added": 7, "retstart": 0}
    assert ingest.ingest(store, "x", "pubmed", "sleep", fetch, 10)["retstart"] == 11
    assert ingest.ingest(store, "y", "pubmed", "sleep", fetch, 10)["added"] == 8
    assert [a[2] for a in asked] == [0, 11, 0]
    before = store.documents.count()

    def failing(rows, path):
        raise OSError("the log can't be written")

    monkeypatch.setattr(ingest.S, "append", failing)
    with pytest.raises(OSError):
        ingest.ingest(store, "z", "pubmed", "sleep", fetch, 10)
    monkeypatch.undo()
    assert store.documents.count() == before and store.imports.count() == 3
    with pytest.raises(ValueError):
        ingest.ingest(store, "x", "pubmed", "none", lambda q, n, o: fetch(q, n, o).limit(0), 10)
    ids = spark.createDataFrame([(f"PMID{k}",) for k in (1, 100, 105, 777)], "id string")
    got = ingest.ingest_ids(store, "x", ids, spark.createDataFrame([("PMID1", "a"), ("PMID100", "b"), ("PMID105", " ")], "id string, abstract string"))
    assert {k: got[k] for k in ("requested", "returned", "usable", "not_found", "without_abstract", "added")} == {"requested": 4, "returned": 3, "usable": 2, "not_found": 1, "without_abstract": 1, "added": 1}


def test_uploads(spark):
    rows = [("C:\\x\\a.XML", b"<a/>"), ("b.txt", b"x"), ("c.json", b""), ("d.nxml", b"<d/>"), ("e.xml", None)]
    files = spark.createDataFrame(rows, "filename string, content binary")
    known = spark.createDataFrame([("upload_" + hashlib.sha256(b"<d/>").hexdigest() + ".nxml",)], "name string")
    got = {r.filename: (r.name, r.error) for r in ingest.uploaded(files, known).collect()}
    assert got["a.XML"] == ("upload_" + hashlib.sha256(b"<a/>").hexdigest() + ".xml", None)
    assert all(got[k][0] is None and got[k][1] for k in ("b.txt", "c.json", "d.nxml", "e.xml"))
    for bad, single in ((files.limit(0), False), (files, True), (files.unionByName(files).unionByName(files), False)):
        with pytest.raises(ValueError):
            ingest.uploaded(bad, single=single)


def test_archive():
    text = JATS.replace(">55<", ">PMC55<").encode()
    name, told = "PMC55.2", []
    md5 = hashlib.md5(text).hexdigest()
    answers = {
        f"{pmc.CONVERTER}?ids=7&format=json": b'{"records": [{"pmid": 7, "pmcid": "PMC55"}]}',
        f"{pmc.CONVERTER}?ids=8&format=json": b'{"records": [{"pmid": 8}]}',
        f"{pmc.OPEN_DATA}?list-type=2&prefix=PMC55.&delimiter=%2F&max-keys=100": b'<L xmlns="u"><IsTruncated>false</IsTruncated><CommonPrefixes><Prefix>PMC55.2/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>PMC55.1/</Prefix></CommonPrefixes></L>',
        f"{pmc.OPEN_DATA}{name}/{name}.json": json.dumps({"pmcid": "PMC55", "version": 2, "xml_url": f"s3://pmc-oa-opendata/{name}/{name}.xml?md5={md5}"}).encode(),
        f"{pmc.OPEN_DATA}{name}/{name}.xml": text,
    }
    now = [0.0]

    def get(address):
        told.append(address)
        return answers[address]

    archive = pmc.Archive(get, lambda: now[0])
    assert archive.pmcid_of("7") == "PMC55" and archive.versions("pmc55") == [1, 2]
    raw, said = archive.text("PMC55", 2)
    assert raw == text and said["sha256"] == hashlib.sha256(text).hexdigest()
    asked = len(told)
    archive.described("PMC55", 2)
    assert len(told) == asked
    now[0] = 301.0
    archive.described("PMC55", 2)
    assert len(told) == asked + 1
    answers[f"{pmc.OPEN_DATA}{name}/{name}.xml"] = text + b" "
    for bad in (lambda: archive.text("PMC55", 2), lambda: archive.pmcid_of("8"), lambda: archive.pmcid_of("x"), lambda: archive.versions("55")):
        with pytest.raises(ValueError):
            bad()


def test_sizes_and_names_are_judged_by_the_listing(spark, folder, tmp_path):
    (tmp_path / "h.xml").write_bytes(b"x" * (articles.MOST_BYTES + 1))
    found = articles.files(spark, folder)
    assert not [r for r in found.select("path").collect() if r.path.endswith("h.xml")]
    assert [r.filename for r in articles.oversized(spark, folder).collect()] == ["h.xml"]
    assert "PushedFilters: [LessThanOrEqual(length" in found._jdf.queryExecution().executedPlan().toString() or "LessThanOrEqual(length,20971520)" in found._jdf.queryExecution().executedPlan().toString()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "state")
    replace(spark.range(3), path)
    replace(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in held(spark, path).collect()) == [1, 2]
    ordered = spark.range(300).select(F.lit("x").alias("collection_id"), (299 - F.col("id")).alias("rank"), F.lit("t").alias("title"))
    write(ordered, str(tmp_path / "ordered"))
    parts = sorted((tmp_path / "ordered").rglob("*.csv"))
    assert [int(line.split(",")[0]) for p in parts for line in p.read_text(encoding="utf-8-sig").splitlines()[1:]] == list(range(300))
    rows = spark.createDataFrame([("x", "=1", 2)], "collection_id string, title string, n int")
    write(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").rglob("*.csv")).read_bytes().decode("utf-8")
    assert text.startswith("﻿title,n")
    assert result_rows.__doc__


PAYLOADS = [
    (1, '{"MedlineCitation": {"Article": {"Abstract": {"AbstractText": "lone"}}, "OtherAbstract": {"AbstractText": {"#text": "o"}}}}'),
    (2, '{"MedlineCitation": {"Article": {"Abstract": {"AbstractText": ["a", null, " ", {"#text": "b"}, {"x": 1}, {"#text": 5}, 7]}}, "OtherAbstract": [null, {"AbstractText": ["p", {"#text": null}, "q"]}]}}'),
    (3, '{"PubmedData": {"ReferenceList": [{"Reference": {"ArticleIdList": {"ArticleId": "r"}}}, {"Reference": [{}, {"ArticleIdList": {"ArticleId": [{"#text": "s"}]}}]}, 4]}}'),
    (4, "{broken"), (5, "[1]"), (6, None), (7, ""), (8, "<PubmedArticle/>"), (9, '{"MedlineCitation": 3}'), (1, '{"PubmedData": {"ArticleIdList": {"ArticleId": ["' + "x" * 200_000 + '"]}}}'),
]


def test_nested(spark):
    df = spark.createDataFrame([(k, p, "clash", 1) for k, p in PAYLOADS], "record_no bigint, payload string, child string, pos int")
    got = sorted((r.record_no, r.child, r.parent_path, r.pos, r.text[:3]) for r in flatten_records(df, "record_no", "payload").collect())
    assert got == [
        (1, "abstract_text", "", 0, "lon"),
        (1, "article_id", "", 0, "xxx"),
        (1, "other_abstract_text", "0", 0, "o"),
        (2, "abstract_text", "", 0, "a"),
        (2, "abstract_text", "", 3, "b"),
        (2, "other_abstract_text", "1", 0, "p"),
        (2, "other_abstract_text", "1", 2, "q"),
        (3, "reference_article_id", "0.0", 0, "r"),
        (3, "reference_article_id", "1.1", 0, "s"),
    ]
    assert flatten_records(df.limit(0), "record_no", "payload").count() == 0
    assert Child("x", ("a",)).repeats == () and F


def test_nested_lists_where_one_is_expected(spark):
    """Parts of a member that comes as a list follow each other; their texts reach Python as list columns only."""
    several = '{"MedlineCitation": [{"Article": {"Abstract": {"AbstractText": ["a", "b"]}}}, {"Article": [{"Abstract": {"AbstractText": "c"}}, {"Abstract": [{"AbstractText": [null, "d"]}]}]}]}'
    df = spark.createDataFrame([(1, several)], "record_no bigint, payload string")
    found = flatten_records(df, "record_no", "payload")
    assert sorted((r.pos, r.text) for r in found.collect()) == [(0, "a"), (1, "b"), (2, "c"), (4, "d")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson") <= 2 and "ArrowEvalPython" not in plan


def test_odd_labels():
    payload = '{"MedlineCitation": {"PMID": "7", "Article": {"Abstract": {"AbstractText": [{"@Label": 5, "@NlmCategory": "AIM", "#text": "a"}, {"@Label": ["x"], "#text": "b"}, {"@Label": " ", "#text": "c"}]}}}}'
    assert payloads.document(payload)["abstract"] == "AIM: a\nb\nc"
    assert payloads.document("[1]") is payloads.document(None) is payloads.document("{") is None
