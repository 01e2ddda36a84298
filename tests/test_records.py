"""Flatteners of researcher and bibliographic records, preprints, employers' domains, reports: small cases with invented people."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from scholarlink.functions import text as T
from scholarlink.jobs import report
from scholarlink.operators import affiliations, people, works
from scholarlink.sources import records


def test_researcher_records(spark):
    raw = spark.createDataFrame(
        [("R1", [("home", "https://a.example"), ("", "")], [([("Lab A", "https://ror.example/1", "ROR", None), ("old", "", "", None)],), ([("Lab B", None, None, "2020")],)], [("doi", "https://doi.org/10.9/A"), ("DOI", "10.9/a"), ("isbn", "1"), ("doi", "10.9/B")])],
        "record_id string, urls array<struct<name:string,value:string>>, groups array<struct<summaries:array<struct<name:string,org_id:string,id_source:string,end_date:string>>>>, ids array<struct<kind:string,value:string>>",
    )
    assert [tuple(r) for r in records.record_urls(raw).collect()] == [("R1", 0, "https://a.example")]
    assert [tuple(r) for r in records.record_employments(raw).orderBy("pos").collect()] == [("R1", 0, "Lab A", "https://ror.example/1", "ROR", True), ("R1", 1, "Lab B", "", "", False)]
    assert [tuple(r) for r in records.record_dois(raw).orderBy("pos").collect()] == [("R1", 0, "10.9/a"), ("R1", 1, "10.9/b")]


def test_bibliography_takes_the_first_result(spark):
    first = ("7", [("Vex M", ["Lab, m.vex@lab.example", "also x.y@lab.example"]), ("Ko N", ["no address"])])
    raw = spark.createDataFrame([("d1", [first, ("8", [("Other O", ["o@lab.example"])])]), ("d2", [])], "doi string, results array<struct<pmid:string,authors:array<struct<name:string,affiliations:array<string>>>>>")
    got = records.flatten_bibliography(raw).collect()
    assert [(r.doi, r.author, r.emails, r.affiliation, r.url) for r in got] == [("d1", "Vex M", ["m.vex@lab.example", "x.y@lab.example"], "Lab, m.vex@lab.example", "https://europepmc.org/abstract/MED/7")]


def test_an_older_version_does_not_stand_in(spark):
    rows = [("10.1101/a", 0, 0, 1, True), ("10.1101/a", 0, 1, 2, False), ("10.1101/a", 1, 0, 1, True), ("10.1101/b", 0, 0, 1, True), ("10.9/c", 0, 0, 1, True)]
    raw = spark.createDataFrame(rows, "doi string, server_rank int, position int, version int, has_jats boolean")
    assert {(r.doi, r.server_rank) for r in records.latest_preprint(raw).collect()} == {("10.1101/a", 1), ("10.1101/b", 0)}


def test_any_white_space_around_at(spark):
    df = spark.createDataFrame([("a.b\tAT\tlab.example",), ("mAThs",)], "t string")
    assert [r[0] for r in df.select(T.may_hold_address(F.col("t"))).collect()] == [True, False]


def test_home_page_addresses_are_not_filtered(spark):
    html = '<a href="mailto:Info@lab.example?x">w</a> <script>z@lab.example</script> m.vex@lab.example office@lab.example'
    df = spark.createDataFrame([(200, "text/html", html), (404, "text/html", html), (200, "application/pdf", html)], "s int, c string, h string")
    got = [r[0] for r in df.select(T.home_page_emails(F.col("s"), F.col("c"), F.col("h"))).collect()]
    assert got == [["info@lab.example", "m.vex@lab.example"], [], []]


def test_employers_domains(spark):
    jobs = spark.createDataFrame([(1, "r1", "ROR", True), (1, "r1", "ROR", False), (2, "r1", "GRID", True), (3, "", "ROR", True)], "person_id long, org_id string, id_source string, current boolean")
    registry = spark.createDataFrame([("r1", ["lab.example", "lab2.example"])], "ror string, domains array<string>")
    assert sorted(map(tuple, affiliations.employer_domains(jobs, registry).collect())) == [(1, "lab.example", "employment"), (1, "lab2.example", "employment")]


def test_official_domains_name_the_registry_first(spark):
    row = [("X", [(0, "https://www.lab.example/a", "company"), (3, "lab.example", "institution"), (2, "https://other.example", "registry")], ["lab.example"])]
    df = spark.createDataFrame(row, "affiliation string, websites array<struct<pos:int,url:string,source:string>>, registry_domains array<string>")
    assert {r.domain: r.sources for r in affiliations.official_domains(df).collect()} == {"lab.example": ["registry", "company", "institution"], "other.example": ["registry"]}


def test_forms_are_guessed_only_without_printed_ones(spark):
    df = spark.createDataFrame([(1, ["고나라"]), (2, ["Petra Vex", "고나라"])], "person_id long, names array<string>")
    got = people.name_forms(df, spark.createDataFrame([("고", ["Ko"])], "surname string, known array<string>")).collect()
    assert {(r.person_id, r.guessed) for r in got} == {(1, True), (2, False)} and "Nara Ko" in {r.form for r in got if r.person_id == 1}


def test_reports(spark):
    asked = spark.createDataFrame([(1, "Petra Vex", "Lab"), (2, "No One", "Nowhere")], "person_id long, name string, affiliation string")
    rows = [(1, 1, "p@lab.example", True, "pdf", "https://a.example", "bears the name"), (1, 2, "p@x.example", False, "html", "", "near"), (1, 3, "p@lab.example", True, "html", "https://b.example", "near")]
    ranked = spark.createDataFrame(rows, "person_id long, rn int, email string, verified boolean, source string, source_url string, attribution string")
    domains = spark.createDataFrame([(2, 0, "nowhere.example", ["registry", "company"])], "person_id long, place int, domain string, sources array<string>")
    lists = report.domain_lists(domains)
    assert lists.first().domains_by == "nowhere.example (registry·company)"
    lines = {r.person_id: r.line for r in report.answer_lines(asked, ranked, lists).collect()}
    assert lines == {1: "- Petra Vex (Lab): p@lab.example [verified · open document (PDF)]", 2: "- No One (Nowhere): no address in open sources · official domains nowhere.example"}
    table = {r.person_id: r.line for r in report.markdown_rows(asked, ranked).collect()}
    assert table == {1: "| 1 | Petra Vex | Lab | p@lab.example | verified | open document (PDF) | bears the name |", 2: "| 2 | No One | Nowhere | - | - | - | - |"}
    ids = spark.createDataFrame([(1, "author", "https://x.example/A1"), (1, "record", "https://r.example/R1")], "person_id long, kind string, url string")
    pages = spark.createDataFrame([(1, 3, "https://a.example/4", "d"), (1, 0, "https://a.example/1", "a"), (1, 1, "www.b.example/2", "b"), (1, 2, "https://a.example/1", "c")], "person_id long, pos int, url string, source string")
    found = report.with_lists(report.findings(asked.withColumn("field", F.lit("")), ranked), report.id_lists(ids), lists, report.page_lists(pages))
    shown = {r.person_id: r for r in report.table_rows(found).collect()}
    assert [x.text for x in shown[1].email] == ["p@lab.example", "p@x.example (unverified)"] and [x.url for x in shown[1].source] == ["https://a.example", "https://b.example"]
    assert [x.text for x in shown[1]["ids"]] == ["record R1", "author A1"] and shown[2].email is None and shown[2].domains == "nowhere.example" and shown[1].field is None
    assert [tuple(x) for x in shown[1].homepage] == [("a.example (c)", "https://a.example/1"), ("b.example (b)", "www.b.example/2")]  # of the first three each once, by its last source
    flat = {r.person_id: r for r in report.summary(found).collect()}
    assert flat[1].others == "p@x.example" and flat[1].record_id == "https://r.example/R1" and flat[1].homepage == "https://a.example/1" and flat[2].status == "not found"


def test_failures_are_remembered_by_kind(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("pdf:a", "1", at(1)), ("pdf:a", None, at(5)), ("page:b", "1", at(1)), ("page:b", None, at(5)), ("page:c", "x", at(4)), ("page:c", "y", at(4)), ("pdf:d", None, at(1))]
    log = spark.createDataFrame(rows, "key string, json string, at timestamp")
    assert {(r.key, r.json) for r in records.latest_responses(log, 60, F.lit(at(6))).collect()} == {("pdf:a", "1"), ("page:b", None), ("page:c", "y")}
    assert {r.key for r in records.latest_responses(log, 1, F.lit(at(6))).collect()} == {"page:b"}


def test_works_are_read_as_a_loop_would(spark):
    rng = random.Random(6)
    rows = []
    for p in range(60):
        earlier = rng.choice([None, 0, 1, 2])
        rows += [(p, k, rng.choice([None, f"u{p}-{k}", f"u{p}-{k}"]), rng.choice([True, True, False, None]), rng.choice([None, 0, 0, 0, 1, 2]), earlier) for k in range(rng.randint(1, 40))]
    want = []
    for p in range(60):
        own = [r for r in rows if r[0] == p]
        cost, tries, hits = 0.0, 0, own[0][5] or 0
        for _, place, url, ok, verified, _ in own:
            if cost >= 8 or tries >= 16:
                break
            if url:
                tries += 1
                cost += 1 if ok else 0.5
                hits += (verified or 0) if ok else 0
                want.append((p, place, url, bool(ok)))
            if hits >= 2:
                break
    rng.shuffle(rows)
    got = works.read_in_order(spark.createDataFrame(rows, "person_id long, place long, url string, ok boolean, verified int, earlier int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
