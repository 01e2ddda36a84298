"""Cases of single operators, with invented people and reserved domains."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarlink.functions import names as N
from scholarlink.functions import orgs as O
from scholarlink.functions import text as T
from scholarlink.operators import evidence, matching
from scholarlink.operators.aliases import alias_table
from scholarlink.sources import records


@pytest.fixture(scope="module")
def none(spark):
    """The aliases known from the start."""
    return alias_table(spark.createDataFrame([], "group_id long, name string"))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, first",
    [
        ("HONG, Gil Dong", ["Gil Dong Hong", "Gildong Hong"]),
        ("HONG GIL DONG", ["Gil Dong Hong", "Gildong Hong", "Hong Gil Dong", "Honggil Dong"]),
        ("ARVIND K. TESTMAN", ["Arvind K. Testman"]),
        ("Gildong", []),
    ],
)
def test_latin_forms(spark, name, first):
    got = one(spark, N.latin_name_forms(F.col("n")), n=name)
    assert got[: len(first)] == first and (first or got == [])


@pytest.mark.parametrize(
    "a, b, same",
    [("HONG Gil Dong", "Gildong Hong", True), ("G. D. Hong", "Gil Dong Hong", True), ("Gildong Hong", "Hong Kiyeong", False), ("", "Hong", False), ("Gil Hong", "Gil Hong", True)],
)
def test_same_person(spark, a, b, same):
    assert one(spark, N.same_person(F.col("a"), F.col("b")), a=a, b=b) is same
    if same:
        assert one(spark, F.arrays_overlap(N.name_keys(F.col("a")), N.name_keys(F.col("b"))), a=a, b=b)


@pytest.mark.parametrize("letter, spellings", [("가", ["ga", "gah", "ka", "kah"]), ("장", ["jang", "jahng", "chang", "chahng"]), ("x", ["x"])])
def test_syllables(spark, letter, spellings):
    assert N.with_spellings(spark.createDataFrame([(letter,)], ["c"]), "c", "s").first().s == spellings


def test_syllable_table_is_whole(spark):
    table = N.syllables(spark)
    assert table.count() == table.select("letter").distinct().count() == 11172
    assert table.where("size(spellings) not between 1 and 4 or not letter rlike '^[가-힣]$'").count() == 0


@pytest.mark.parametrize(
    "name, first, others",
    [("장 나라", ["Nara Jang", "Na Ra Jang"], []), ("고나", ["Na Ko", "Nah Ko"], ["Na Go", "Na Koh"]), ("뷁나", ["Na Bwek"], []), ("abc", None, []), ("나", None, []), ("가나다라마", None, [])],
)
def test_romanisation(spark, name, first, others):
    rows = N.romanize(spark.createDataFrame([(name,), (name,), (None,)], "n string"), "n").collect()
    if first is None:
        assert rows == []
    else:
        assert rows[0].forms[: len(first)] == first and set(others) <= set(rows[0].forms) and len(rows[0].forms) <= 16 and len(rows) == 1


@pytest.mark.parametrize(
    "email, names, theirs",
    [("gildong", ["Gildong Goh"], True), ("gdgoh", ["GOH Gil Dong"], True), ("lab", ["Gildong Goh"], False), ("gildong", ["고길동"], False), ("gdgoh", [], False)],
)
def test_attribution(spark, email, names, theirs):
    df = spark.createDataFrame([(email, names)], "e string, n array<string>")
    assert df.select(evidence.attributed_by_account(F.col("e"), F.col("n")).alias("x")).first().x is theirs


@pytest.mark.parametrize(
    "a, b, strict, same",
    [
        ("Alder Inst. of Tech.", "Alder Institute of Technology", True, True),
        ("Alder Institute of Mining", "Alder Institute of Farming", True, False),
        ("Alder Systems (South Korea)", "ALDER SYSTEMS CO LTD", True, True),
        ("Alder University", "Alder University Hospital", True, False),
        ("Alder University", "Alder University Hospital", False, True),
        ("AIT", "Alder Institute of Technology", False, True),
    ],
)
def test_same_org(spark, none, a, b, strict, same):
    got = matching.match_orgs(spark.createDataFrame([(a,)], ["a"]), spark.createDataFrame([(b,)], ["b"]), "a", "b", none, strict)
    assert (got.count() == 1) is same
    if strict:
        row = spark.createDataFrame([(a, b, 1)], "a string, b string, kept int")
        assert (matching.where_same_org(row, "a", "b", none).count() == 1) is same


def test_alias_of_a_group(spark):
    groups = alias_table(spark.createDataFrame([(1, "ABCDE"), (1, "Birch Laboratories")], "group_id long, name string"))
    left, right = spark.createDataFrame([("ABCDE",)], ["a"]), spark.createDataFrame([("Birch Lab. Inc.",)], ["b"])
    assert matching.match_orgs(left, right, "a", "b", groups).count() == 1  # by the content words of an alias
    assert matching.match_orgs(left, right, "a", "b", groups, strict=True).count() == 0
    right = spark.createDataFrame([("Birch Laboratories",)], ["b"])
    assert matching.match_orgs(left, right, "a", "b", groups, strict=True).count() == 1


@pytest.mark.parametrize(
    "mail, official, fits", [("ee.uni.ac.kr", "uni.ac.kr", True), ("is.org1.de", "tue.org1.de", True), ("a.ac.kr", "b.ac.kr", False), ("uni.example", "www.uni.example", True), ("xuni.example", "uni.example", False)]
)
def test_domains(spark, mail, official, fits):
    assert one(spark, O.domain_matches(F.col("a"), F.col("b")), a=mail, b=official) is fits


def test_expansion(spark):
    assert one(spark, O.expand_abbreviations(F.col("n")), n="Univ. of Alder") == "University of Alder"
    assert one(spark, O.expand_abbreviations(F.col("n")), n="University of Alder") == ""
    assert one(spark, O.org_key(F.col("n")), n="Princeton") == "preton"  # legal forms go inside words too


def test_text(spark):
    t = "a.b [at] lab (dot) example; info@lab.example c@x.example.png {p, q} @ lab.example"
    assert one(spark, T.extract_emails(F.col("t")), t=t) == ["a.b@lab.example"]
    assert one(spark, T.expand_braces(F.col("t")), t="{p, q} @ lab.example").endswith("\np@lab.example\nq@lab.example")
    assert one(spark, T.is_personal_mail(F.col("d")), d="olive.com") is True  # a provider's word before a dot, anywhere
    assert one(spark, T.extract_emails(F.col("t")), t="irene@lab.example") == []  # role words match at the start
    assert one(spark, T.snippet(F.col("t"), F.lit("NEEDLE")), t="<b>some</b>  needle here") == "some needle here"
    assert one(spark, T.host_rank(F.col("u")), u="https://x.edu/a.pdf") == 0


def test_verification(spark):
    hits = spark.createDataFrame([(1, "a@ee.org1.example", False), (1, "a@gmail.example", False), (1, "b@else.example", False), (2, "c@org2.example", False), (2, "d@gmail.example", True)], "person_id long, email string, self_stated boolean")
    domains = spark.createDataFrame([(1, "www.org1.example")], "person_id long, domain string")
    got = {r.email: (r.verification, r.verified) for r in evidence.verify(hits, domains).collect()}
    assert got == {"a@ee.org1.example": ("official domain", True), "a@gmail.example": ("personal mail", False), "b@else.example": ("other domain", False), "c@org2.example": ("no domain", False), "d@gmail.example": ("record", True)}


def test_people_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffNo,name,Name,소속,name,org\r\n1,old,x,Alder,\"Goh, \"\"G\"\"\nGil\",Birch\r\n2,a,b,,c,d\r\n3\r\n".encode())
    got = [tuple(r) for r in records.read_people(spark, str(tmp_path / "a.csv"), "any").collect()]
    assert got == [('Goh, "G"\nGil', "Alder", "any")]  # of equal headers the last column; the first known header of a kind; no affiliation, no person
    (tmp_path / "b.csv").write_text("who,where,else\nMoreau,Fir,z\n")
    assert [tuple(r) for r in records.read_people(spark, str(tmp_path / "b.csv")).collect()] == [("Moreau", "Fir", "")]
    (tmp_path / "c.csv").write_text("")
    assert records.read_people(spark, str(tmp_path / "c.csv")).count() == 0


def test_company_list(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<?xml version='1.0'?><result><list><corp_code> 01 </corp_code><corp_name>Alder</corp_name><stock_code> </stock_code><x>1</x></list><list><corp_code>02</corp_code></list></result>")
    assert [tuple(r) for r in records.read_companies(spark, str(tmp_path / "c.xml")).collect()] == [("01", "Alder", "")]


def test_people_file(spark):
    raw = spark.createDataFrame([("Goh", "Alder", None), ("", "Birch", "x"), (None, "Fir", "y")], "Name string, org string, Field string")
    assert [tuple(r) for r in records.people_of(raw, "any").collect()] == [("Goh", "Alder", "any")]
    with pytest.raises(ValueError):
        records.validate_people(spark.range(51).selectExpr("'a' as name", "'b' as affiliation", "'' as field"))
