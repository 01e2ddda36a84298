"""Line dedup: repeated runs of lines by prefix doubling over line ids, in DataFrame operations only.

A document is a sequence of line ids. Every start of a line is a suffix; at depth h the suffixes that share their first h
lines, all within their documents, form one interval of the suffix array, of common prefix length h at least. Doubling the
depth names the intervals of 2h lines by the pair of intervals at p and p + h. An interval of one suffix can't become a
repeat again and leaves at once, so the work follows the repeated lines only. Each interval is named by its first place in
the corpus (by doc_id, then line); all its other suffixes are later copies, and the lines they cover are deleted. A covered
line points to the source of the interval that reaches furthest; lines in a row that point along one source form a maximal run.

A run counts from `min_lines` lines on; if that is no power of two, intervals of just that depth are named as well, by the two
intervals of half of it or more that make it up. With `long_words`, a single line counts too if it has that many words or is all
that its document has, blank ones aside.

What later copies cover is found by a running maximum of where they end, so the work grows with the lines and not with the
lengths of the runs. Places of one name are summed up in as many parts as shuffles have partitions before they meet, so a very
common line is no single task's.

Nulls, empties, repeats: a null text has no lines and stays null; an empty text is one empty line. Blank lines are lines.
Rows that repeat doc_id and text are one place in the corpus: none is a copy of the other. Of rows with one doc_id and
different texts the order is that of a hash of the text. A null doc_id comes before all others. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, buckets, only, stash


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _document(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_d", F.struct(F.col("doc_id"), F.xxhash64(F.col("text")).alias("fp")))


def _repeats(named: DataFrame, *others: str) -> DataFrame:
    """(d, line, name, others) -> (d, line, first, others): only suffixes whose name occurs at several places, with the first of them."""
    place = F.struct("d", "line")
    dealt = named.withColumn("part", F.pmod(F.xxhash64("d", "line"), F.lit(buckets(named.sparkSession)))).repartition("name", "part")
    parts = dealt.groupBy("name", "part").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    whole = parts.groupBy("name").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first != last").select("name", "first")
    known = parts.select("name", "part").join(whole, "name")
    return dealt.join(known, ["name", "part"]).select("d", "line", "first", *others)


def _next_depth(level: DataFrame, ahead: int) -> DataFrame:
    """The intervals named by those of a level at p and at p + ahead."""
    there = W.partitionBy("d").orderBy("line").rangeBetween(ahead, ahead)
    pairs = level.withColumn("then", F.min("first").over(there)).where("then is not null")
    return _repeats(pairs.select("d", "line", F.struct("first", "then").alias("name")))


def line_intervals(docs: DataFrame, long_words: int | None = None, extra: int = 1) -> list[tuple[int, DataFrame]]:
    """(depth, (d, line, first)) for depths 1, 2, 4, ... and extra as long as any interval has several suffixes; at depth 1 also whether the line counts by itself."""
    lines = _document(only(docs, "doc_id", "text")).select(F.col("_d").alias("d"), (~F.col("text").contains("\n")).alias("only"), F.posexplode(_lines(F.col("text"))).alias("line", "content"))
    counts = F.lit(False)
    if long_words is not None:
        many = F.when(F.length("content") >= 2 * long_words - 1, F.regexp_count("content", F.lit(WORD)) >= long_words).otherwise(False)
        counts = F.when(F.col("only"), F.col("content").rlike(WORD)).otherwise(many)
    level = stash(_repeats(lines.select("d", "line", F.unhex(F.md5(F.col("content").cast("binary"))).alias("name"), counts.alias("counts")), "counts"), "lines1")
    out, depth = [], 1
    while not level.isEmpty():
        out.append((depth, level))
        if depth == 1:
            level = level.dropDuplicates(["d", "line"])  # rows of the table that repeat
        if depth < extra < 2 * depth:
            out.append((extra, stash(_next_depth(level, extra - depth), f"lines{extra}")))
        level = stash(_next_depth(level, depth), f"lines{2 * depth}")
        depth *= 2
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """d (struct doc_id, fp), start, n_lines, source (struct d, line): the maximal runs of lines that are later copies."""
    if min_lines < 1:
        raise ValueError("min_lines has to be 1 or more")
    reach = F.struct((F.col("line") + F.col("depth")).alias("stop"), (-F.col("line")).alias("start"), "first")
    rows = None
    for depth, level in line_intervals(docs, long_words, min_lines):
        alone = depth == 1 < min_lines and long_words is not None
        counts = F.struct("d", "line") > F.col("first")
        if depth < min_lines:
            counts = counts & F.col("counts") if alone else F.lit(False)
        if depth == 1 or depth >= min_lines:  # a covered line is a repeated one, so depth 1 has them all
            here = level.withColumn("depth", F.lit(depth)).select("d", "line", F.when(counts, reach).alias("reach"))
            rows = here if rows is None else rows.unionByName(here)
    if rows is None:
        rows = _document(only(docs, "doc_id", "text")).select(F.col("_d").alias("d"), F.lit(0).alias("line")).limit(0)
        rows = rows.select("d", "line", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("start"), F.struct("d", "line").alias("first")).alias("reach"))
    so_far = F.max("reach").over(W.partitionBy("d").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    covered = rows.groupBy("d", "line").agg(F.max("reach").alias("reach")).withColumn("reach", so_far).where("reach.stop > line")
    lined = covered.select("d", "line", F.col("reach.first.d").alias("source"), (F.col("reach.first.line") + F.col("line") + F.col("reach.start")).alias("at"))
    place = W.partitionBy("d").orderBy("line")
    along = (F.lag("source").over(place) == F.col("source")) & (F.lag("at").over(place) + 1 == F.col("at")) & (F.lag("line").over(place) + 1 == F.col("line"))
    runs = lined.withColumn("new", F.when(along, 0).otherwise(1)).withColumn("run", F.sum("new").over(place))
    return runs.groupBy("d", "run").agg(F.min("line").alias("start"), F.count(F.lit(1)).cast("int").alias("n_lines"), F.min(F.struct(F.col("source").alias("d"), F.col("at").alias("line"))).alias("source")).drop("run")


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """docs with text without the lines of repeated runs, and n_lines, n_removed, runs (struct start, n_lines, source_doc_id, source_line).

    A text all of whose lines go becomes empty. Columns of docs with these three names are replaced; all others stay.
    """
    docs = docs.drop("n_lines", "n_removed", "runs", "_d", "_lines", "_gone")
    run = F.struct("start", "n_lines", F.col("source.d.doc_id").alias("source_doc_id"), F.col("source.line").alias("source_line"))
    runs = repeated_runs(docs, min_lines, long_words).groupBy("d").agg(F.array_sort(F.collect_list(run)).alias("runs"))  # as many as the document has lines, at most
    joined = _document(docs).join(runs.withColumnRenamed("d", "_d"), "_d", "left")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n_lines"] - 1)))
    lines = F.col("_lines")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    return (
        joined.withColumn("_lines", _lines(F.col("text")))
        .withColumn("_gone", gone)
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")))
        .withColumn("n_lines", F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
        .drop("_d", "_lines", "_gone")
    )

