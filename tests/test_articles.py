"""Articles: notes, editors, malformed texts; addresses by what stands before them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarlink.operators.proximity import attributed_by_proximity
from scholarlink.sources.jats import author_emails, parse_jats

AUTHOR = "<contrib{a}><name><surname>{s}</surname><given-names>{g}</given-names></name>{x}</contrib>"


def article(authors, notes):
    return f"<article xmlns='urn:x'><contrib-group>{''.join(authors)}</contrib-group><author-notes>{notes}</author-notes></article>"


def linked(spark, xml):
    df = spark.createDataFrame([(1, xml)], "doc_id long, xml string")
    return {r.name: (list(r.emails), r.corresp) for r in author_emails(parse_jats(df)).collect()}


def test_notes_by_reference(spark):
    a = AUTHOR.format(a="", s="Goh", g="Gil", x='<xref ref-type="corresp" rid="n"/>')
    editor = AUTHOR.format(a=' contrib-type="editor"', s="Itor", g="Ed", x="<email>e@lab.example</email>")
    got = linked(spark, article([a, editor, AUTHOR.format(a="", s="Moreau", g="Una", x="")], '<corresp id="n">To ggoh@lab.example</corresp>'))
    assert got == {"Gil Goh": (["ggoh@lab.example"], True), "Una Moreau": ([], False)}


def test_shared_note_is_split_by_account(spark):
    ref = '<xref ref-type="corresp" rid="n"/>'
    both = [AUTHOR.format(a="", s=s, g=g, x=ref) for s, g in (("Satori", "Miran"), ("Moreau", "Una"))]
    got = linked(spark, article(both, '<corresp id="n"><email>msatori@lab.example</email> <email>moreau@lab.example</email></corresp>'))
    assert got["Miran Satori"][0] == ["msatori@lab.example"] and got["Una Moreau"][0] == ["moreau@lab.example"]


@pytest.mark.parametrize("note, emails", [('<corresp id="n">a@lab.example</corresp>', ["a@lab.example"]), ("<corresp>a@lab.example</corresp>", [])])
def test_the_only_note_goes_to_the_only_marked_author(spark, note, emails):
    # a note without id is counted twice, so it isn't the only one
    assert linked(spark, article([AUTHOR.format(a=' corresp="yes"', s="Goh", g="Gil", x="")], note)) == {"Gil Goh": (emails, True)}


def test_malformed_articles_have_no_rows(spark):
    df = spark.createDataFrame([(1, "<article>"), (2, None), (3, "")], "doc_id long, xml string")
    assert parse_jats(df).count() == 0


@pytest.mark.parametrize(
    "text, names, theirs",
    [
        ("Gildong Goh <lab@uni.example>", ["Gildong Goh"], True),
        ("Gildong Goh and Maria Stone <lab@uni.example>", ["Gildong Goh"], False),
        ("Gildong Goh a@b.example <lab@uni.example>", ["Gildong Goh"], False),
        ("고길동 lab@uni.example", ["고길동"], True),
        ("Gildong Goh " + "x" * 200 + " lab@uni.example", ["Gildong Goh"], False),
        ("no address", ["Gildong Goh"], False),
    ],
)
def test_proximity(spark, text, names, theirs):
    df = spark.createDataFrame([(text, names)], "t string, n array<string>")
    assert df.select(attributed_by_proximity(F.col("t"), F.lit("lab@uni.example"), F.col("n")).alias("x")).first().x is theirs


def test_proximity_needs_no_python(spark):
    df = spark.createDataFrame([("t", "e", ["n"])], "t string, e string, n array<string>")
    plan = df.select(attributed_by_proximity(F.col("t"), F.col("e"), F.col("n")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "text, names, theirs",
    [
        ("Goh, Gil. Then Gildong Goh: a(b@uni.example", ["Gil Goh", "Gildong Goh"], True),  # the last place of a name counts
        ("GILDONG GOH\n\nB@UNI.example", ["Gildong Goh"], True),
        ("Gildong Goh, Gil Dong Goh b@uni.example", ["Gildong Goh"], True),  # the same person once more
        ("Maria Stone, Gildong b@uni.example", ["Gildong Goh"], True),  # a part of four letters
        ("Goh b@uni.example", ["Gildong Goh"], False),  # a part of three
        ("Gildong Goh of b@uni.example; Maria Stone: b@uni.example", ["Gildong Goh"], True),
    ],
)
def test_proximity_backwards(spark, text, names, theirs):
    df = spark.createDataFrame([(text, names)], "t string, n array<string>")
    assert df.select(attributed_by_proximity(F.col("t"), F.lit("b@uni.example"), F.col("n")).alias("x")).first().x is theirs
