"""Filter interaction audit: what each order of five filters removes, by direct relational replay.

Every document gets one flag for each filter, whether it fails it. The flags are crossed with the broadcast table of all orders
(120 for five filters, a size fixed by the number of filters), each order is exploded to its steps, the first failing step of a document
under an order is computed from its flags, and conditional sums by part, order and step give the counts. Map-side combining comes
first and last: documents of one part with equal flags and labels are one row with a count before they are crossed (32 x 4 rows a
part at most for five filters), and partial sums go into the last shuffle. So what is crossed does not grow with the documents of a part, and a part
that holds a third of all documents is as small as the others. replay() takes documents uncombined as well: weight 1 each.

Flags A to D depend on the text alone and are column functions. E needs the smallest doc_id of equal texts: the SHA-256 of a text stands
for it, repeated ones are found by an aggregation with partial sums, and only those are joined back, against a side with one row a text, so
adaptive execution can split a hot text. Texts are read once; only doc_id, part, flags and hash are shuffled. Labels meet documents by doc_id;
rows without doc_id skip that join.

Nulls, empties, repeats: a null text is an empty one, a null source the empty part. A document without words has 0 words and fails A
but not B; an empty one doesn't fail C. A row without doc_id has no labels, fails E for no other document and makes none fail it. Rows that
repeat doc_id and text count each; none is a smaller doc_id to the other. A document is good (toxic) if any of its label rows says so.
Columns other than doc_id, text and source are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, stash

FILTERS = "ABCDE"


def text_failures(text: Column, words: Column, n_words: Column) -> dict[str, Column]:
    """Whether a text fails the filters that look at nothing else."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": F.when(n_words == 0, False).otherwise(F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n_words * F.lit(50).cast("long")),
        "C": capitals * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) and labels (doc_id, quality, toxic) -> doc_id, part, good, toxic, A to E: a row for each document."""
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(docs["doc_id"], F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("bare", F.btrim("text", F.lit(" \t\n\v\f\r"))).withColumn("words", F.split("bare", r"[\x20\x09-\x0D]+"))
    own = own.withColumn("n_words", F.when(F.col("bare") == "", 0).otherwise(F.size("words")))
    failures = text_failures(F.col("text"), F.col("words"), F.col("n_words"))
    own = stash(own.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), *[c.alias(k) for k, c in failures.items()]), "flags")
    first = own.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1").select("h", "first")
    first = stash(first, "first")  # a table of its own, so that adaptive execution can split a hot text's side of the join
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E")
    flagged = own.join(first, "h", "left").select("doc_id", "part", *failures, late)
    rated = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    named = flagged.where("doc_id is not null").join(rated, "doc_id", "left").select("doc_id", "part", *said, *FILTERS)
    return named.unionByName(flagged.where("doc_id is null").select("doc_id", "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), *FILTERS))


def combine(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Documents of one part with equal flags and labels as one row with their number, weight."""
    return flags.groupBy("part", "good", "toxic", *filters).agg(F.count(F.lit(1)).alias("weight"))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters: filter_order, steps array<struct step, filter>."""
    rows = [("".join(p), [(k + 1, x) for k, x in enumerate(p)]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, filter: string>>").coalesce(1)


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """flags (part, good, toxic, a boolean for each filter, weight) -> part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row a part, order and step. kept: documents that pass the filters up to this step; removed: those whose first failure is this step;
    redundant: those that fail this filter after an earlier one; unique_fails: those that fail this filter alone; good_lost and toxic_lost: those removed here with the
    label; shapley: what the filter removes, summed over all orders. At most 7 filters, as orders grow with their factorial.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError("one to seven different filters are needed")
    failing = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in filters]))
    crossed = flags.select("part", "good", "toxic", "weight", failing.alias("failing")).crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    first = F.array_min(F.transform(F.filter("steps", lambda s: F.array_contains("failing", s["filter"])), lambda s: s["step"]))
    steps = crossed.withColumn("first", F.coalesce(first, F.lit(len(filters) + 1))).select("*", F.explode("steps").alias("at")).select("*", "at.step", "at.filter")
    here, fails = F.col("first") == F.col("step"), F.array_contains("failing", F.col("filter"))
    total = lambda when, name: F.sum(F.when(when, F.col("weight")).otherwise(0)).alias(name)
    counts = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("first") > F.col("step"), "kept"),
        total(here, "removed"),
        total(fails & (F.col("first") < F.col("step")), "redundant"),
        total(fails & (F.size("failing") == 1), "unique_fails"),
        total(here & F.col("good"), "good_lost"),
        total(here & F.col("toxic"), "toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))  # a row for each order


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of filters A to E over documents, by source."""
    return replay(combine(document_flags(docs, labels)))
