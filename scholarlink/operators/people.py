"""From requested people to author records: candidates, their order, and the decision between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import latin_name_forms, romanize, same_person, with_nfkc
from .matching import match_names


def name_forms(people: DataFrame, surnames: DataFrame | None = None, most: int = 16) -> DataFrame:
    """(person_id, names array) -> person_id, form_rank, form, guessed: Latin forms of all names, or, where there is none, guesses for the first other name. surnames as names.romanize() takes them."""
    printed = F.array_distinct(F.flatten(F.transform("names", latin_name_forms)))
    other = F.get(F.filter("names", lambda n: n.rlike(r"[^\x00-\x7F]")), F.lit(0))
    rows = people.select("person_id", printed.alias("printed"), other.alias("other"))
    known = rows.where(F.size("printed") > 0).select("person_id", F.posexplode("printed").alias("form_rank", "form"), F.lit(False).alias("guessed"))
    rest = rows.where((F.size("printed") == 0) & F.col("other").isNotNull()).select("person_id", "other")
    guess = rest.join(romanize(rest, "other", surnames, most), "other").select("person_id", F.posexplode("forms").alias("form_rank", "form"), F.lit(True).alias("guessed"))
    return known.unionByName(guess)


def learnt_names(people: DataFrame, linked: DataFrame) -> DataFrame:
    """(person_id, names) with the printed names (person_id, display_name) of the authors that a guessed form led to, each once, at the end."""
    found = linked.groupBy("person_id").agg(F.array_sort(F.collect_set("display_name")).alias("learnt"))
    return people.join(found, "person_id", "left").withColumn("names", F.array_distinct(F.concat("names", F.coalesce("learnt", F.array().cast("array<string>"))))).drop("learnt")


def candidates(forms: DataFrame, authors: DataFrame, pairs: DataFrame, affiliations: DataFrame) -> DataFrame:
    """Authors that share a name and an institution with a person.

    forms (person_id, form_rank, form), authors (author_id, display_name, works_count, topics array, and, if wanted, alternatives array, of which ten count), affiliations
    (author_id, institution, current), pairs (person_id, institution): the institutions that match the person's. They meet by the
    name and the institution at once: by the name alone, all authors of a common name would meet all people of that name.
    -> person_id, author_id, display_name, works_count, topics, form_rank, current.
    """
    other = F.slice("alternatives", 1, 10) if "alternatives" in authors.columns else F.array().cast("array<string>")
    spelled = authors.select("author_id", F.explode(F.array_distinct(F.concat(F.array("display_name"), F.coalesce(other, F.array().cast("array<string>"))))).alias("spelling"))
    same = match_names(forms.select("form"), spelled.select("spelling"), "form", "spelling")
    asked = forms.join(same, "form").groupBy("person_id", "spelling").agg(F.min("form_rank").alias("form_rank")).join(pairs.select("person_id", "institution"), "person_id")
    met = asked.join(spelled.join(affiliations, "author_id"), ["spelling", "institution"])
    linked = met.groupBy("person_id", "author_id").agg(F.min("form_rank").alias("form_rank"), F.max("current").alias("current"))
    known = authors.select("author_id", "display_name", "works_count", "topics").distinct()
    return linked.join(known, "author_id").select("person_id", "author_id", "display_name", "works_count", "topics", "form_rank", "current")


def on_topic(cands: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates with topic_hit: a term of the person's field (person_id, terms) is part of a topic, or the other way round."""
    hit = F.exists("terms", lambda t: F.exists("topics", lambda x: F.lower(x).contains(t) | t.contains(F.lower(x))))
    return cands.join(terms, "person_id", "left").withColumn("topic_hit", F.coalesce(hit, F.lit(False))).drop("terms")


def ordered(cands: DataFrame) -> DataFrame:
    """Candidates with rn: current ones first, then those on the person's topic, then by number of works."""
    place = W.partitionBy("person_id").orderBy(F.desc("current"), F.desc("topic_hit"), F.desc("works_count"), "form_rank", "author_id")
    return cands.withColumn("rn", F.row_number().over(place))


def decide(cands: DataFrame) -> DataFrame:
    """Candidates left after narrowing to current ones, then to those on the topic, as long as several are left; with unique."""
    own = W.partitionBy("person_id")
    n, n_current = F.count(F.lit(1)).over(own), F.sum(F.col("current").cast("int")).over(own)
    some = cands.withColumn("n", n).withColumn("nc", n_current).where("n = 1 or nc = 0 or current").drop("n", "nc")
    n, n_topic = F.count(F.lit(1)).over(own), F.sum(F.col("topic_hit").cast("int")).over(own)
    some = some.withColumn("n", n).withColumn("nt", n_topic).where("n = 1 or nt = 0 or topic_hit").drop("n", "nt")
    return some.withColumn("unique", F.count(F.lit(1)).over(own) == 1)


def like_first(ranked: DataFrame) -> DataFrame:
    """Ordered candidates with same_as_first: whether the name can be that of the person's first candidate, compared within the row."""
    first = F.max(F.when(F.col("rn") == 1, F.col("display_name"))).over(W.partitionBy("person_id"))
    composed = with_nfkc(with_nfkc(ranked.withColumn("_first", first), "_first", "_a"), "display_name", "_b")
    return composed.withColumn("same_as_first", same_person(F.col("_a"), F.col("_b"))).drop("_first", "_a", "_b")


def dominant(cands: DataFrame, same_second: str = "same_as_first", works: int = 20, times: int = 3) -> DataFrame:
    """Of ordered candidates, the first if it has `works` works and `times` those of the second, or is the second; then the second too."""
    own = W.partitionBy("person_id")
    first, second = F.max(F.when(F.col("rn") == 1, F.col("works_count"))).over(own), F.max(F.when(F.col("rn") == 2, F.col("works_count"))).over(own)
    same = F.coalesce(F.max(F.when(F.col("rn") == 2, F.col(same_second))).over(own), F.lit(False))
    fine = (first >= works) & (second.isNull() | (first >= times * F.greatest(second, F.lit(1))) | same)
    return cands.withColumn("_fine", fine).withColumn("_same", same).where("_fine and (rn = 1 or (rn = 2 and _same))").drop("_fine", "_same")


def stop_forms(cands: DataFrame, enough: int = 4) -> DataFrame:
    """Candidates of the forms, in order of rank, before which fewer than `enough` candidates were found."""
    counts = cands.groupBy("person_id", "form_rank").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("person_id").orderBy("form_rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cands.join(counts.withColumn("before", before).where(F.col("before") < enough).select("person_id", "form_rank"), ["person_id", "form_rank"], "left_semi")


def hold_records(records: DataFrame, employments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Researcher records less those that have employments, none of which matches the person's affiliation."""
    listed = employments.select("person_id", "record_id").distinct()
    fits = employments.join(pairs, ["person_id", "institution"]).select("person_id", "record_id").distinct()
    held = listed.join(fits, ["person_id", "record_id"], "left_anti")
    return records.join(held, ["person_id", "record_id"], "left_anti")


def search_records(found: DataFrame) -> DataFrame:
    """The researcher record that each person's first deciding form gives.

    found (person_id, form_rank, record_id, has_institution, fits): exact name matches. A form decides if it has one match
    that lists no institution or a fitting one, else if just one of its matches fits.
    """
    each = found.groupBy("person_id", "form_rank").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("n_fit"), F.min("record_id").alias("only"), F.min(F.when(F.col("fits"), F.col("record_id"))).alias("fit"), F.max(F.col("fits") | ~F.col("has_institution")).alias("fine")
    )
    chosen = each.withColumn("record_id", F.when((F.col("n") == 1) & F.col("fine"), F.col("only")).when((F.col("n") > 1) & (F.col("n_fit") == 1), F.col("fit"))).where("record_id is not null")
    return chosen.groupBy("person_id").agg(F.min_by("record_id", "form_rank").alias("record_id"))
