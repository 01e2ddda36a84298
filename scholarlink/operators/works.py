"""Works of linked authors: which are taken, in which order, and how many of their documents are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import host_rank


def works_of(linked: DataFrame, works: DataFrame, newest: int = 25) -> DataFrame:
    """(person_id, author_rank, author_id) x works (author_id, work_id, doi, year, ...) -> the newest of each author, each DOI or work once; pos is the order."""
    recent = W.partitionBy("person_id", "author_id").orderBy(F.desc("year"), "work_id")
    rows = linked.join(works, "author_id").withColumn("nth", F.row_number().over(recent)).where(F.col("nth") <= newest)
    key = F.coalesce(F.nullif(F.lower(F.regexp_replace("doi", "(?i)^https?://(dx\\.)?doi\\.org/", "")), F.lit("")), F.col("work_id").cast("string"))
    once = W.partitionBy("person_id", "key").orderBy("author_rank", "nth")
    rows = rows.withColumn("key", key).withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("person_id").orderBy("author_rank", "nth", "key")))


def topic_first(works: DataFrame, terms: str = "terms", text: str = "about") -> DataFrame:
    """works in new order (place): those whose text holds one of the person's terms first, otherwise as before (pos)."""
    hit = F.exists(F.col(terms), lambda t: F.lower(F.col(text)).contains(t))
    return works.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("place", F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("hit"), "pos")))


def first_with_doi(works: DataFrame, count: int = 6) -> DataFrame:
    rows = works.where("doi is not null and doi != ''").withColumn("nth", F.row_number().over(W.partitionBy("person_id").orderBy("place")))
    return rows.where(F.col("nth") <= count)


def one_address(locations: DataFrame) -> DataFrame:
    """(work_id, pos, url) -> one url a work: of the best host, then the first."""
    return locations.groupBy("work_id").agg(F.min_by("url", F.struct(host_rank(F.col("url")), F.col("pos"), F.col("url"))).alias("url"), F.min(host_rank(F.col("url"))).alias("rank"))


def within_budget(tries: DataFrame, budget: float = 8.0, failure: float = 0.5) -> DataFrame:
    """(person_id, place, ok) -> those tried while the cost before is below the budget and the tries before below twice that."""
    before = W.partitionBy("person_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    cost = F.coalesce(F.sum(F.when(F.col("ok"), 1.0).otherwise(failure)).over(before), F.lit(0.0))
    return tries.withColumn("cost_before", cost).withColumn("tried_before", F.count(F.lit(1)).over(before)).where((F.col("cost_before") < budget) & (F.col("tried_before") < 2 * budget))


def early_stop(reads: DataFrame, enough: int = 2) -> DataFrame:
    """(person_id, place, earlier, verified) -> reads before which fewer than `enough` verified hits were known; the first always."""
    own = W.partitionBy("person_id").orderBy("place")
    so_far = F.col("earlier") + F.coalesce(F.sum("verified").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return reads.withColumn("known", so_far).withColumn("rn", F.row_number().over(own)).where((F.col("rn") == 1) | (F.col("known") < enough)).drop("rn")


def addresses_to_read(works: DataFrame, locations: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """works (person_id, place, work_id, doi, ...) with url: a work's best location, else, where it has none, the best of the fall-back addresses of its DOI, else null.

    locations (work_id, pos, url), fallbacks (doi, urls) as fallback_pdfs() gives them.
    """
    own = one_address(locations).select("work_id", F.col("url").alias("own"))
    first = fallbacks.select("doi", F.posexplode("urls").alias("pos", "url")).groupBy("doi").agg(F.min_by("url", F.struct(host_rank(F.col("url")), F.col("pos"))).alias("other"))
    out = works.join(own, "work_id", "left").join(first.where("doi != ''"), "doi", "left")
    return out.withColumn("url", F.coalesce("own", "other")).drop("own", "other")


def read_in_order(works: DataFrame, budget: float = 8.0, failure: float = 0.5, enough: int = 2) -> DataFrame:
    """works (person_id, place, url, ok, verified, earlier) -> person_id, place, url, ok: the addresses tried, read or not.

    One pass over each person's works in order, which carries the cost, the tries and the verified hits so far: a read costs 1, a failure, or an address that
    no document is known for (ok null), `failure`. A work is come to while the cost is below the budget and the tries below twice that; after any work, with an address or
    without, `enough` verified hits end the pass, those known earlier (null: none) included. verified: the hits that reading the address gives.
    """
    one = F.struct("place", "url", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("verified", F.lit(0)).cast("long").alias("verified"))
    listed = works.groupBy("person_id").agg(F.array_sort(F.collect_list(one)).alias("w"), F.coalesce(F.max("earlier"), F.lit(0)).cast("long").alias("earlier"))  # a person's few works
    kept = "array<struct<place:bigint,url:string,ok:boolean>>"
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("tries"), F.col("earlier").alias("hits"), F.lit(False).alias("over"), F.array().cast(kept).alias("tried"))

    def step(s: Column, w: Column) -> Column:
        come_to = ~s["over"] & (s["cost"] < budget) & (s["tries"] < 2 * budget)
        tried = come_to & w["url"].isNotNull()
        hits = F.when(tried & w["ok"], s["hits"] + w["verified"]).otherwise(s["hits"])
        one = F.array(F.struct(w["place"].cast("long").alias("place"), w["url"].alias("url"), w["ok"].alias("ok")))
        return F.struct(
            F.when(tried, s["cost"] + F.when(w["ok"], 1.0).otherwise(failure)).otherwise(s["cost"]).alias("cost"),
            F.when(tried, s["tries"] + 1).otherwise(s["tries"]).alias("tries"),
            hits.alias("hits"),
            (~come_to | (hits >= enough)).alias("over"),
            F.when(tried, F.concat(s["tried"], one)).otherwise(s["tried"]).alias("tried"),
        )

    return listed.select("person_id", F.explode(F.aggregate("w", start, step)["tried"]).alias("t")).select("person_id", "t.*")


def fallback_pdfs(dois: DataFrame, a: DataFrame, b: DataFrame, c: DataFrame, most: int = 3) -> DataFrame:
    """doi -> urls: up to three of list a, else the single one of b, else up to three of list c."""
    cut = lambda x: F.nullif(F.slice(F.array_distinct(F.filter(x, lambda u: u.isNotNull() & (u != ""))), 1, most), F.array().cast("array<string>"))
    rows = dois.join(a.withColumnRenamed("urls", "a"), "doi", "left").join(b.withColumnRenamed("url", "b"), "doi", "left").join(c.withColumnRenamed("urls", "c"), "doi", "left")
    none = F.array().cast("array<string>")
    return rows.select("doi", F.coalesce(cut(F.col("a")), F.when(F.col("b") != "", F.array("b")), cut(F.col("c")), none).alias("urls"))
