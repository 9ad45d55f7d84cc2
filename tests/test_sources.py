"""Saved pages of services, small functions, sinks and builds."""

import json

import pytest
from pyspark.sql import functions as F

from litspark.functions import text
from litspark.operators import records, trials
from litspark.sources import adapters, files, sinks

PAGES = {
    "epmc": {"resultList": {"result": [{"id": "1", "source": "MED", "pmid": "1", "doi": "https://doi.example/10.1/A", "title": "T", "authorString": "Doe J, Roe R.", "abstractText": "x", "firstPublicationDate": "2020-01-02", "journalInfo": {"journal": {"title": "J"}}, "isOpenAccess": "Y", "pubTypeList": {"pubType": ["Retracted Publication"]}, "meshHeadingList": {"meshHeading": [{"descriptorName": "A", "majorTopic_YN": "Y"}, {"descriptorName": "B", "majorTopic_YN": "N"}]}}]}},
    "openalex": {"results": [{"id": "W1", "doi": "https://doi.example/10.1/b", "display_name": "T", "publication_date": "2020-01-01", "open_access": {"is_oa": True}, "authorships": [{"author": {"display_name": "A B"}, "institutions": [{"display_name": "U"}, {"display_name": "V"}]}, {"author": {"display_name": "C D"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]},
    "clinicaltrials": {"studies": [{"protocolSection": {"identificationModule": {"nctId": "NCT01234567", "briefTitle": "T"}, "descriptionModule": {"briefSummary": "s"}, "statusModule": {"overallStatus": "RECRUITING", "startDateStruct": {"date": "2020-01"}}}}]},
    "nih": {"results": [{"project_title": "T", "appl_id": "7", "core_project_num": "R01", "project_start_date": "2020-02-03T00:00:00", "organization": {"org_name": "O"}}]},
    "nsf": {"response": {"award": [{"id": "9", "title": "T", "date": "07/15/2023"}]}},
    "core": {"results": [{"id": "3", "title": "T", "authors": [{"name": "A"}, {"name": "B"}], "yearPublished": 2019}]},
    "patents": {"patentFileWrapperDataBag": [{"applicationNumberText": "5", "applicationMetaData": {"inventionTitle": "T", "patentNumber": "P1", "inventorBag": [{"inventorNameText": "I"}], "filingDate": "2018-01-01"}}]},
    "scopus": {"entry": [{"dc_title": "T", "dc_creator": "D", "prism_doi": "10.1/S", "openaccessFlag": False}]},
    "preprints": {"collection": [{"title": "T", "doi": "10.1/p", "published": "10.1/J", "authors": "A;B", "date": "2021-01-01"}, {"title": "U", "doi": "10.1/q", "published": "NA"}]},
}


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    for name, page in PAGES.items():
        (folder / name / "sub").mkdir(parents=True)
        (folder / name / "sub" / "1.json").write_text(json.dumps(page, indent=1))
    (folder / "core" / "2.json").write_text('{"results": [{"title"')
    return str(folder)


def test_services(spark, pages):
    wanted = {**dict.fromkeys(PAGES, True), "nowhere": True, "nih": True, "scopus": True}
    plans, status = adapters.read_services(spark, pages, wanted)
    state = {r.source: r.status for r in status.collect()}
    assert state == {**dict.fromkeys(PAGES, "ok"), "core": "partial", "nowhere": "failed"}
    assert set(adapters.read_services(spark, pages, {"nih": True, "epmc": False})[0]) == {"nih"}
    rows = {n: df.collect() for n, df in plans.items()}
    e, o, c = rows["epmc"][0], rows["openalex"][0], rows["clinicaltrials"][0]
    assert (e.doi, e.authors, e.is_retracted, e.mesh_major, e.mesh_all, e.source) == ("10.1/A", "Doe J; Roe R", True, "A", "A; B", "EPMC")
    assert (o.abstract, o.authors, o.is_open_access, json.loads(o.affiliations)) == ("a b a", "A B; C D", "Y", [["U", "V"], []])
    assert (c.nct_id, c.publication_date) == ("NCT01234567", "Start: 2020-01 | End: Ongoing | Status: RECRUITING")
    n, f = rows["nih"][0], rows["nsf"][0]
    assert (n.grant_id, n.publication_date, n.affiliations) == ("R01", "2020-02-03", "O") and n.url.endswith("/7") and f.grant_id == "9" and f.url.endswith("=9")
    assert rows["core"][0].authors == "A; B" and rows["core"][0].publication_date == "2019" and rows["patents"][0].grant_id == "P1" and rows["patents"][0].publication_date == "2018-01-01"
    assert [(r.doi, r.published_doi) for r in sorted(rows["preprints"], key=lambda r: r.doi)] == [("10.1/p", "10.1/J"), ("10.1/q", None)]
    more = adapters.enriched(plans["scopus"], spark.createDataFrame([("doi:10.1/s", "long one"), ("10.1/S", "x"), ("10.1/z", None)], "doi string, abstract string"))
    assert more.head().abstract == "long one" and more.count() == 1
    assert adapters.read_service(spark, "core", f"{pages}/core").count() == 1


def test_queries_of_services():
    assert adapters.nsf_keyword('gene AND "viral vector"') == '"viral vector" AND gene' and adapters.core_query("a b") == '(title:"a b" OR abstract:"a b")' and adapters.core_query("title:a") == "title:a"
    assert adapters.batched_terms(["b", "A", '"b" ', "c" * 50, " "], 2, 20) == [["A", "b"], ["c" * 50]]


def test_author_affiliations(spark):
    df = spark.createDataFrame([("A; B", "U"), ("A", None), (None, "U")], "a string, u string")
    got = [json.loads(r.x) for r in df.select(adapters.author_affiliations(F.col("a"), F.col("u")).alias("x")).collect()]
    assert got == [[{"name": "A", "affiliations": "U"}, {"name": "B", "affiliations": "U"}], [{"name": "A", "affiliations": "No affiliation available"}], []]


def test_pubmed_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<Set><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></Set>")
    df = files.xml_records("pubmed", str(tmp_path), "PubmedArticle", adapters.PUBMED).read(spark)
    r = adapters.pubmed(df).head()
    assert (r.pmid, r.title, r.abstract) == ("12", "T", "a b")


def test_sections(spark):
    xml = "<article><body><sec><title>One</title><p>a <i>b</i></p><sec><title>In</title><p>c</p></sec></sec><sec><p>d</p></sec></body></article>"
    df = spark.createDataFrame([(xml,), ("<article><body>only <b>text</b></body></article>",), ("<broken",), (None,)], "x string")
    got = [[(s.title, s.text) for s in r.sections] for r in files.jats_sections(df, "x").collect()]
    assert got == [[("One", "a b"), ("In", "c"), (None, "d")], [(None, "only text")], [], []]
    assert files.jats_sections(df, "x").select(files.sectioned_text(F.col("sections")).alias("t")).head().t == "--- One ---\na b\n\n--- In ---\nc\n\nd"


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(text.split_terms(F.lit(" a;; b ;"))) == ["a", "b"] and one(text.split_terms(F.lit(None))) == []
    assert one(text.plural(F.lit(1), "trial")) == "1 trial" and one(text.plural(F.lit(1200), "trial")) == "1,200 trials"
    assert len(one(text.session_hash(F.lit("s"), "k"))) == 16 and one(text.session_hash(F.lit("s"), "k")) != one(text.session_hash(F.lit("s"), "l"))
    assert [str(one(text.log_time(F.lit(v)))) for v in ("2026-01-02T03:04:05Z", "2026-01-02 03:04:05 CET", "2026-01-02 03:04:05", "no")] == ["2026-01-02 03:04:05"] * 3 + ["None"]
    cut = one(text.truncated_text(F.lit("ab\u200bcdef"), 3))
    assert (cut.text, cut.total_chars, cut.truncated) == ("abc\n[truncated]", 7, True)
    assert one(text.coverage_item(F.lit("E"), F.lit(50), F.lit(1234), F.lit("partial"))) == "E: 50 of 1,234 (stopped early)" and one(text.coverage_item(F.lit("C"), F.lit(0), F.lit(None).cast("int"), F.lit("failed"))) == "C: no response"
    df = spark.createDataFrame([("https://a.example/x", "10.1234/a", "<b onclick='x'>t</b>", '{"a": "<i>"}', 5), ("javascript:x", "no doi", None, "{broken", 6)], "url string, doi string, t string, j string, n int")
    rows = [tuple(r) for r in text.sanitized(df, {"url": "url", "doi": "doi", "t": "text", "j": "json", "absent": "text"}).collect()]
    assert rows == [("https://a.example/x", "10.1234/a", "<b>t</b>", '{"a": "\\u003ci>"}', 5), (None, None, None, None, 6)]


def test_records(spark):
    df = spark.createDataFrame([("b", 2), (None, 3), (" ", 1), ("a", 4)], "i string, n int")
    assert {(r.i, r.n) for r in records.with_fallback_id(df, "i", ["n"]).collect()} == {("b", 2), ("a", 4), ("unknown_id_1", 1), ("unknown_id_2", 3)}
    known = spark.createDataFrame([("x",), ("y",)], "t string")
    assert {r.t for r in records.grown_vocabulary(known, spark.createDataFrame([("y",), ("z",), (" ",)], "t string"), "t").collect()} == {"x", "y", "z"}
    assert records.release_name("2026-01-01", {"a": b"1", "b": b"2"}) == records.release_name("2026-01-01", {"b": b"2", "a": b"1"}) != records.release_name("2026-01-01", {"a": b"2", "b": b"1"})


def test_contacts_go(spark):
    s = "s struct<protocolSection:struct<contactsLocationsModule:struct<centralContacts:array<string>,locations:array<struct<facility:string,contacts:array<string>>>>,other:int>>"
    df = spark.createDataFrame([(((((["c"], [("F", ["x"])])), 7),),)], s)
    r = df.select(trials.without_contacts(F.col("s")).alias("s")).head().s.asDict(recursive=True)
    assert r == {"protocolSection": {"contactsLocationsModule": {"locations": [{"facility": "F"}]}, "other": 7}}


def test_builds_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "b")
    one, two = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,)], "n int")
    sinks.publish_build(spark, {"t": one}, path, "r1")
    with pytest.raises(Exception, match="broken"):
        sinks.publish_build(spark, {"t": two, "u": two.select(F.raise_error(F.lit("broken")).alias("x"))}, path, "r2")
    assert sinks.published(spark, path, "t").head().n == 1
    sinks.publish_build(spark, {"t": two}, path, "r3")
    assert sinks.published(spark, path, "t").head().n == 2
    store = str(tmp_path / "s")
    rows = spark.createDataFrame([("N1", "a"), ("N2", "b")], "nct_id string, v string")
    for _ in range(2):  # a date is written once
        m = sinks.take_snapshot({"q1": rows, "q2": rows.where("nct_id = 'N1'"), "q3": None}, store, "2026-01-01", "nct_id")
    assert {(r.query_id, r.n, r.complete) for r in m.collect()} == {("q1", 2, True), ("q2", 1, True), ("q3", 0, False)}
    assert {(r.nct_id, tuple(r.matched_queries)) for r in spark.read.parquet(store).collect()} == {("N1", ("q1", "q2")), ("N2", ("q1",))}
    made = []
    make = lambda: made.append(1) or one
    for age in (None, 1.0, -1.0):
        sinks.cached(spark, str(tmp_path / "c"), "k", make, max_age_days=age)
    assert len(made) == 2


def test_exports_and_import(spark, tmp_path):
    df = spark.createDataFrame([("T", "A; B", "J", "2020-01-02", "10.1/x", ["p", "q"]), ("U", None, None, None, None, [])], "title string, authors string, journal string, publication_date string, doi string, tags array<string>")
    assert [r.value for r in sinks.endnote(df).collect()] == ["%0 Journal Article\n%T T\n%A A\n%A B\n%J J\n%D 2020\n%R 10.1/x", "%0 Journal Article\n%T U"]
    sinks.export_csv(df, str(tmp_path / "csv"), ["title"])
    assert [r.tags for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()] == ["p; q", None]
    assert sinks.markdown_header("2026-01-01", {"b": "2", "a": "1"}, 3).split("\n")[2:5] == ["3 items, exported 2026-01-01", "- a: 1", "- b: 2"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text('{"r": "a", "h": "CA978112CA1BBDCAFAC231B39A23DC4DA786EFF8147C4E72B9807785AFEE48BB"}\n{"r": "b", "h": "00"}\n')
    good, bad = files.verified_import(spark, str(tmp_path / "in"), "r string, h string", F.sha2("r", 256), "h")
    assert [r.r for r in good.collect()] == ["a"] and [r.r for r in bad.collect()] == ["b"]
