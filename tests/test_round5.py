"""Cases that round 3's findings named."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarlink.llm import jaccard
from scholarlink.operators import evidence, matching, people
from scholarlink.operators.aliases import alias_table


def test_a_group_hides_no_key_of_its_names(spark):
    """a short name whose group goes by a longer key is still found in others by its own."""
    groups = alias_table(spark.createDataFrame([(1, "Alder East Univ."), (1, "Alder East University")], "group_id long, name string"))
    left = spark.createDataFrame([("Alder East Univ.",)], ["a"])
    right = spark.createDataFrame([("Alder East Chemical Industries Inc.",), ("Alder West Chemical Industries Inc.",)], ["b"])
    assert [r.b for r in matching.match_orgs(left, right, "a", "b", groups).collect()] == ["Alder East Chemical Industries Inc."]
    assert [r.a for r in matching.match_orgs(right, left, "b", "a", groups).collect()] == ["Alder East Univ."]
    assert matching.match_orgs(left, right, "a", "b", groups, strict=True).count() == 0


def test_people_and_authors_of_one_name_meet_at_their_institutions_alone(spark):
    """the join of names has the institution in its keys, so a common name makes no more rows than there are candidates."""
    n = 40
    forms = spark.createDataFrame([(k, r, f) for k in range(n) for r, f in enumerate(("Jona Goh", "J. Goh"))], "person_id long, form_rank int, form string")
    authors = spark.createDataFrame([(f"a{k}", "Goh, Jona", 5, ["x"]) for k in range(n)], "author_id string, display_name string, works_count long, topics array<string>")
    at = spark.createDataFrame([(f"a{k}", f"org{k}", k % 2 == 0) for k in range(n)] + [("a0", "org1", True)], "author_id string, institution string, current boolean")
    pairs = spark.createDataFrame([(k, f"org{k}") for k in range(n)], "person_id long, institution string")
    found = people.candidates(forms, authors, pairs, at)
    got = {(r.person_id, r.author_id, r.form_rank, r.current) for r in found.collect()}
    assert got == {(k, f"a{k}", 0, k % 2 == 0) for k in range(n)} | {(1, "a0", 0, True)}
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    named = [line for line in joins if line.count("spelling#") > 1]
    assert named and all("institution#" in line for line in named)


def test_sets_that_meet_late_in_their_prefixes_make_no_pairs(spark, monkeypatch):
    """op7: in the last round a pair is made at its first common n-gram alone, which has to be early enough in both sets; links are kept."""
    made = []
    near_enough = jaccard._near_enough
    monkeypatch.setattr(jaccard, "_near_enough", lambda pairs, percent: made.append(pairs.count()) or near_enough(pairs, percent))
    n, rows = 1000, []  # 251 n-grams in a prefix; sketches that tell nothing apart
    rows += [(7, c, n, 200) for c in range(40)]  # met late: 800 n-grams at most in common, 858 needed
    rows += [(8, c, n, 142 + c % 2) for c in (50, 51, 52)]  # at the edge: 858 of both
    rows += [(9, c, n, 150) for c in (50, 52)]  # their second common n-gram
    rest = spark.createDataFrame(rows, "token long, c long, n int, pos int").withColumns({"label": F.col("c"), "weight": F.when(F.col("token") == 7, 1).otherwise(60), **{k: F.lit(0).cast("long") for k in jaccard.SKETCH}})
    sizes = rest.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    got = {(r.a, r.b) for r in jaccard._all_pairs(rest, sizes, 75).collect()}
    assert got == {(50, 52)} and made == [1]
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    assert {(r.a, r.b) for r in jaccard._all_pairs(rest, sizes, 75).collect()} == got


def test_articles_and_their_readers_are_joined_once(spark):
    """names are composed before the join, which is not made again for each of the two columns of names."""
    works = spark.range(3).selectExpr("id as person_id", "'d' as key")
    authors = spark.createDataFrame([("d", "Ａｎｎ Lee", True, ["a@x.example"]), ("d", "Bo Kim", False, ["b@x.example"]), ("e", "Ann Lee", False, ["c@x.example"])], "key string, name string, corresp boolean, emails array<string>")
    names = spark.createDataFrame([(0, "Lee, Ann"), (1, "Ｂ. Kim"), (2, None)], "person_id long, name string")
    found = evidence.by_article(works, authors, names, "article")
    assert {(r.person_id, r.key, r.email, r.author, r.corresp) for r in found.collect()} == {(0, "d", "a@x.example", "Ａｎｎ Lee", True), (1, "d", "b@x.example", "Bo Kim", False)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3") == 1
