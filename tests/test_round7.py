"""Tests for the findings of round 4."""

from collections import Counter

from pyspark.sql import functions as F

from scholarlink.functions.text import extract_emails, snippet
from scholarlink.operators import evidence
from scholarlink.operators.proximity import attributed_by_proximity


def test_full_texts_are_used_to_their_end(spark):
    """j11_full_text_evidence: a name next to an address counts wherever it stands, and each address has a quote."""
    reads, names = spark.createDataFrame([(1, "u")], "person_id long, url string"), spark.createDataFrame([(1, ["Ann Lee"])], "person_id long, names array<string>")
    others = "; ".join(f"Maria Stone (m{k}@x.example)" for k in range(30))
    text = f"Maria Stone (lab@x.example); {others}; {'word ' * 4000}Ann Lee (lab@x.example); Ann Lee: q1@x.example"
    found = evidence.by_full_text(reads, spark.createDataFrame([("u", "pdf", text)], "url string, kind string, text string"), names).collect()
    assert sorted((r.email, r.by) for r in found) == [("lab@x.example", "place"), ("q1@x.example", "place")]
    quotes = {r.email: r.snippet for r in found}
    assert quotes["lab@x.example"].startswith("Maria Stone (lab@x.example); Maria") and quotes["q1@x.example"].endswith("word Ann Lee (lab@x.example); Ann Lee: q1@x.example")


TEXTS = [
    ("a", "Ann Lee xlee@x.example.org, lee@x.example, Bo Kim LEE@X.example"),  # within a longer address, in another case
    ("a", "Bo Kim lee@x.example"),  # the same url again
    ("b", "Ann Lee @ e@x.co@@@e@x.com " + "@" * 300 + " Bo Kim\n.e@x.co. Bo Kim lee (at) x.example"),
    ("c", "Bo Kim b@kim.example, b@kim.example " + "w" * 170 + "b@kim.example"),  # a place of the same address ends what stands before
    ("d", "Mr Ann @ Lee q@x.example " + "高 " * 5000 + "Ann Lee: z@x.example, Ann Lee%z@x.example"),
    ("e", None),
    ("f", ""),
]


def test_full_texts_give_what_the_rule_gives_for_whole_texts(spark):
    documents = spark.createDataFrame([(u, "pdf", t) for u, t in TEXTS + TEXTS[:1]], "url string, kind string, text string")
    names = spark.createDataFrame([(1, ["Ann Lee"]), (2, ["Bo Kim", None]), (3, ["Ann @ Lee"])], "person_id long, names array<string>")
    rows = documents.select("url", "text", F.explode(extract_emails(F.col("text"))).alias("email")).crossJoin(names)
    account = evidence.attributed_by_account(F.substring_index("email", "@", 1), F.col("names"))
    by = F.when(account, "account").when(attributed_by_proximity(F.col("text"), F.col("email"), F.col("names")), "place")
    want = rows.select("person_id", "url", "email", by.alias("by"), snippet(F.col("text"), F.col("email")).alias("snippet")).where("by is not null").collect()
    reads = names.select("person_id").crossJoin(documents.select("url").distinct())
    got = evidence.by_full_text(reads, documents, names).select("person_id", "url", "email", "by", "snippet").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and {r.url for r in want} == {"a", "b", "c", "d"}
