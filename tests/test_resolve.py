"""The whole job over one invented snapshot: six people, each of whom comes to their addresses, or to none, by another way."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scholarlink.jobs import report
from scholarlink.jobs.resolve import SCHEMAS, resolve

FJORD, FIRM, LODGE, GREBE = "Fjordmark Polytechnic", "Ottergrid Electronics Co., Ltd.", "Quillon Lodge of Letters", "Grebe Institute"
NOTE = "<article><front><contrib-group>{}</contrib-group><author-notes>{}</author-notes></front></article>"
WRITER = '<contrib contrib-type="author"><string-name>{}</string-name>{}</contrib>'
REF = '<xref ref-type="fn" rid="{}"/>'


@pytest.fixture(scope="module")
def out(spark):
    shared = NOTE.format(WRITER.format("T. Marwick", REF.format("n")) + WRITER.format("Odo Zann", REF.format("n")), '<fn id="n"><email>tmarwick@fjordmark.example</email> <email>ozann@fjordmark.example</email></fn>')
    inline = NOTE.format(WRITER.format("Tilda Marwick", "<email>tilda@fjordmark.example</email>") + '<contrib contrib-type="editor"><string-name>Tilda Marwick</string-name><email>ed@fjordmark.example</email></contrib>', "")
    rows = {
        "companies": [("0007", "수달전자", "", "Wrong Otter", "no.example"), ("0009", "수달전자", "77", FIRM, "www.ottergrid.example"), ("0011", FJORD, "1", "Never Asked", "x.example")],
        "entities": [(LODGE, 0, "Q1", "Quillon Lodge", "a film", ""), (LODGE, 1, "Q2", LODGE, "foundation for letters", "")],
        "entity_sites": [("Q2", 0, "https://quillon.example/home"), ("Q2", 1, "ftp://quillon.example")],
        "registry": [("r/1", FJORD, [FJORD, "FJP", "Fjordmark Polyteknisk"], "https://www.fjordmark.example", ["fjordmark.example"]), ("r/2", "Ottergrid Research", ["Ottergrid Research"], None, ["research.example"])],
        "institutions": [("i1", "Fjordmark Polyteknisk", ["FJORDMARK POLYTECHNIC"], "https://fjp.example", None), ("i2", "OTTERGRID ELECTRONICS", [], None, "r/2")],
        "groups": [(1, FJORD), (1, "Nordic Polytechnic of Fjordmark"), (2, "Nordic Polytechnic of Fjordmark"), (2, "Fjordskolen")],
        "authors": [
            ("a1", "Tilda Marwick", ["T Marwick"], "", 31, ["Sail aerodynamics"]), ("a2", "Tilda Marwick", [], "", 9, ["Botany"]), ("a3", "Tilda Marwick", [], "", 400, ["Sail aerodynamics"]),
            ("b1", "Ko Mirae", [], "rec/b", 60, ["Filters"]), ("b2", "Mirae Ko", [], "", 21, ["Filters"]), ("c1", "Ugo Brandt", [], "", 3, []), ("e1", "Lene Ahm", [], "", 2, []),
        ],
        "author_affiliations": [("a1", "Fjordskolen", True), ("a2", FJORD, False), ("a3", "Bay University", True), ("b1", "Ottergrid Electronics", True), ("b2", "OTTERGRID ELECTRONICS INC", True), ("c1", LODGE, False), ("e1", GREBE, True)],
        "records": [("rec/b", "Ko Mirae", "Ottergrid Electronics"), ("rec/h", "Hedda Voss", ""), ("rec/u", "Ugo Brandt", "")],
        "record_employments": [("rec/b", 0, "Ottergrid Electronics", "r/2", "ROR", True), ("rec/h", 0, "Elsewhere Mills", "", "", True)],
        "record_emails": [("rec/h", 0, "hedda@mills.example", "record"), ("rec/u", 0, "ugo.b@lodge.example", "biography")],
        "record_urls": [("rec/u", 0, "https://ugo.example/"), ("rec/u", 1, "https://ugo.example/teaching"), ("rec/u", 2, "https://ugo.example/third")],
        "record_dois": [("rec/u", 0, "10.7/more"), ("rec/u", 1, "10.7/letters"), ("rec/u", 2, "10.7/last")],
        "works": [
            ("a1", "w1", "https://doi.org/10.1101/SAIL", 2020, "Wind in canvas", ["Sail aerodynamics"]), ("a1", "w2", "10.5/b", 2024, "Hulls", ["Keels"]), ("a1", "w3", None, 2023, "Masts", None), ("a1", "w4", None, 2019, "Sail lofts", []),
            ("b1", "w5", "10.6/f", 2022, "Filters one", []), ("b2", "w6", None, 2021, "Filters two", []), ("e1", "w7", None, 2021, "Birds", []),
        ],
        "locations": [("w3", 0, "https://files.example/masts.pdf"), ("w4", 0, "https://www.mdpi.com/lofts"), ("w4", 1, "https://repository.example/lofts.pdf"), ("w6", 0, "https://files.example/two.html"), ("w7", 0, "https://files.example/birds.pdf")],
        "pdf_lists": [("10.7/letters", "b", ["https://core.ac.uk/letters.pdf"]), ("10.7/letters", "c", ["https://files.example/never.pdf"]), ("10.7/more", "a", ["https://files.example/gone.pdf"]), ("10.7/last", "c", ["https://files.example/last.pdf"]), ("10.6/f", "a", ["https://files.example/one.pdf"])],
        "bibliography": [("10.5/b", "Marwick T", "t.marwick@fjordmark.example"), ("10.5/b", "Zann O", "zann@fjordmark.example")],
        "articles": [("10.1101/sail", "preprint", shared), ("10.5/b", "article", inline), ("10.5/b", "preprint", inline), ("10.9/none", "article", inline)],
        "documents": [
            ("https://repository.example/lofts.pdf", 200, "application/pdf", "pdf", "Tilda Marwick (sails@fjordmark.example) and Odo Zann (hulls@fjordmark.example)"), ("https://files.example/masts.pdf", 200, "application/pdf", "pdf", "tmarwick@late.example"),
            ("https://core.ac.uk/letters.pdf", 200, "application/pdf", "pdf", "Letters by Ugo Brandt, ubrandt@quillon.example"), ("https://files.example/one.pdf", 403, "text/html", "html", "mirae@ottergrid.example"),
            ("https://files.example/two.html", 200, "text/html", "html", "Ko Mirae mirae.koh@gmail.example, lab@ottergrid.example"),
            ("https://files.example/birds.pdf", 200, "application/pdf", "pdf", "Lene Ahm: lahm@grebe.example, lahm@script.example"),
        ],
        "pages": [
            ("https://ugo.example/", 200, "text/html", '<p>Hello</p><a href="mailto:quill@ugo.example">write</a>'), ("https://ugo.example/teaching", 404, "text/html", "ubrandt@gone.example"), ("https://ugo.example/third", 200, "text/html", "ubrandt@third.example"),
            ("https://www.grebe.example/", 200, "text/html", f"<b>The {GREBE.upper()}</b>"), ("https://script.example/", 200, "text/html", f"<script>{GREBE}</script>nothing here"),
        ],
    }
    snapshot = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    people = [(1, "Marwick, Tilda", FJORD, "sail / wing", ["Tilda Anne Marwick"]), (2, "고미래", "수달전자", "", None), (3, "Ugo Brandt", LODGE, "letters", []), (4, "Hedda Voss", FJORD, "", []), (5, "Lene Ahm", GREBE, "", []), (6, "한", "Nowhere At All", "", [])]
    people = spark.createDataFrame(people, "person_id long, name string, affiliation string, field string, name_variants array<string>")
    return people, resolve(people, snapshot)


@pytest.fixture(scope="module")
def evidence(out):
    return {(r.person_id, r.email, r.source): r for r in out[1]["evidence"].collect()}


def test_authors_are_told_apart(out):
    linked = {(r.person_id, r.author_id): (r.unique, r.guessed) for r in out[1]["linked"].collect()}
    # 1: one of three namesakes is there now; 2: two guessed candidates, of whom neither stands out but one name is the other's; 3: a former member
    assert linked == {(1, "a1"): (True, False), (2, "b1"): (False, True), (2, "b2"): (False, True), (3, "c1"): (True, False), (5, "e1"): (True, False)}
    names = {r.person_id: r.names for r in out[1]["names"].collect()}
    assert names[1] == ["Marwick, Tilda", "Tilda Anne Marwick"] and names[2] == ["고미래", "Ko Mirae", "Mirae Ko"]


def test_each_route_gives_what_it_should(evidence):
    found = {k: r.verification for k, r in evidence.items()}
    assert found[1, "t.marwick@fjordmark.example", "bibliography"] == "official domain"
    assert found[1, "tilda@fjordmark.example", "article"] == "official domain"
    assert found[1, "tmarwick@fjordmark.example", "preprint"] == "official domain"
    assert found[3, "ugo.b@lodge.example", "record"] == "record"
    assert found[3, "ubrandt@quillon.example", "pdf"] == "official domain"  # by a fall-back address
    assert found[2, "mirae.koh@gmail.example", "html"] == "personal mail"
    assert not {e for _, e, _ in found} & {"ozann@fjordmark.example", "ed@fjordmark.example", "zann@fjordmark.example", "hulls@fjordmark.example", "lab@ottergrid.example", "mirae@ottergrid.example", "hedda@mills.example", "ubrandt@gone.example", "ubrandt@third.example"}
    assert found[5, "lahm@grebe.example", "pdf"] == "domain's own page" and found[5, "lahm@script.example", "pdf"] == "no domain"  # a name in a script confirms nothing
    assert {p for p, *_ in found} == {1, 2, 3, 5}


def test_reading_ends_when_enough_is_known(out, evidence):
    tried = {(r.person_id, r.url): r.ok for r in out[1]["tried"].collect()}
    # 1: the field brings w4 forward, and after the first work of all two verified addresses are known already; 3: an address that no document is known for costs a try
    assert not any(p == 1 for p, _ in tried)
    assert tried == {(2, "https://files.example/one.pdf"): False, (2, "https://files.example/two.html"): True, (3, "https://files.example/gone.pdf"): False, (3, "https://core.ac.uk/letters.pdf"): True, (5, "https://files.example/birds.pdf"): True}
    assert (1, "sails@fjordmark.example", "pdf") not in evidence


def test_domains_and_identifiers(out):
    domains = {(r.person_id, r.domain): r.sources for r in out[1]["domains"].collect()}
    assert domains[1, "fjordmark.example"] == ["registry"] and domains[1, "fjp.example"] == ["institution"]
    assert domains[2, "ottergrid.example"] == ["company"] and domains[2, "research.example"] == ["registry", "employment"]  # the institution's registry id was followed
    assert domains[3, "quillon.example"] == ["entity"] and domains[5, "grebe.example"] == ["own page"]
    ids = {(r.person_id, r.kind): r.url for r in out[1]["identifiers"].collect()}
    assert ids == {(1, "author"): "a1", (1, "registry"): "r/1", (2, "registry"): "r/2", (2, "record"): "rec/b", (5, "author"): "e1", (3, "author"): "c1", (3, "record"): "rec/u", (4, "registry"): "r/1"}


def test_log_says_what_happened(out):
    log = {}
    for r in out[1]["log"].orderBy("person_id", "step").collect():
        log.setdefault(r.person_id, []).append(r.text)
    assert any(x.startswith("names · guessed") for x in log[2]) and "names · no Latin form" in log[6]
    assert "domains · no domain known" in log[5] and "domains · no domain known" in log[6] and "record held · rec/h (other employers)" in log[4]
    assert "documents · 2 tried, failed: HTTP 403 x1" in log[2] and "documents · 2 tried, failed: no answer x1" in log[3]
    assert "bibliography · 1 records" in log[1] and log[6][-1] == "result · 0 addresses, 0 verified"


def test_reports(out, spark):
    people, tables = out
    text = report.answer(tables["statuses"], tables["lines"]).first().text.split("\n")
    assert text[0] == "Of 6 people an address was found for 4 (verified for 3)." and len(text) == 7
    doc = json.loads(report.nested(report.answer(tables["statuses"], tables["lines"]), tables["table"], tables["cards"]).first().json)
    assert [doc[k]["type"] for k in ("answer", "email_table", "email_cards", "notice")] == ["answer", "table", "card", "text"]
    table, card = doc["email_table"]["data"][0], doc["email_cards"]["data"][0]
    assert table["order"] == list(table["fields"]) and set(table["link"]) < set(table["order"]) and table["note"] and table["caption"]
    assert [set(r) for r in table["rows"]] == [set(table["order"])] * 6 and [r["rank"] for r in table["rows"]] == [1, 2, 3, 4, 5, 6]
    assert [r["status"] for r in table["rows"]] == ["verified", "unverified", "verified", "not found", "verified", "not found"]
    assert {"text": "mirae.koh@gmail.example (unverified)", "url": "mailto:mirae.koh@gmail.example"} in table["rows"][1]["email"] and table["rows"][5]["email"] is None
    assert {"text": "quillon.example (entity)", "url": "https://quillon.example/home"} == table["rows"][2]["homepage"][0]
    assert card["title"] == "name" and card["rows"][0]["affil_names"].startswith("Fjord") and card["rows"][5]["log"].startswith("- names")
    flat = {r.person_id: r for r in tables["summary"].collect()}
    assert flat[3].record_id == "rec/u" and flat[3].author_id == "c1" and flat[3].homepage == "https://quillon.example/home" and flat[6].best is None
    assert flat[1].status == "verified" and flat[1].others and flat[1].domains.split(", ")[0] == "fjordmark.example"
    with pytest.raises(Exception, match="1 to 2 people"):
        report.answer(tables["statuses"], tables["lines"], most=2).collect()


def test_writing_keeps_other_dates(out, spark, tmp_path):
    _, tables = out
    chosen = {"summary": tables["summary"], "table": tables["table"], "log": tables["log"]}
    report.write(chosen, str(tmp_path), "2026-01-01")
    report.write(chosen, str(tmp_path), "2026-01-02")
    count = lambda name, kind="parquet": {str(r.run_date): r["count"] for r in spark.read.format(kind).options(header=True).load(f"{tmp_path}/{kind}/{name}").groupBy("run_date").count().collect()}
    assert count("summary") == {"2026-01-01": 6, "2026-01-02": 6}
    again = {k: df.where("person_id < 3") for k, df in chosen.items()} | {"log": tables["log"].where("false")}
    report.write(again, str(tmp_path), "2026-01-02")
    assert count("summary") == count("table", "csv") == {"2026-01-01": 6, "2026-01-02": 2}
    assert set(count("log")) == {"2026-01-01"}  # no rows of the run before are left
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/notice").first().notice == report.NOTICE
    first = json.loads(spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv/table").where("person_id = 1").first().email)
    assert first[0]["url"].startswith("mailto:")
    nested = spark.read.parquet(f"{tmp_path}/parquet/table").where("person_id = 3").select(F.col("email")[0]["text"].alias("e")).first()
    assert nested.e
