"""Shards of near-equal size by longest-processing-time scheduling.

Groups that must stay together, sorted by size from the largest, go to the least-loaded shard, kept in a heap. Groups of
one size are alike, so the heap works on a histogram (size, number of groups) and not on the groups: sizes up to EXACT are
kept as they are, larger ones fall in classes 1/4096 wide, so the histogram has at most 65,536 + 4,096 * 48 rows however
many groups there are. Large classes are dealt first; their true sums then set the heap for the exact ones.

Nulls, empties, repeats: a null text counts no bytes; all null texts are one group, apart from the empty text. Repeated
rows are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets, only, stash

EXACT = 1 << 16


def size_class(size: Column) -> Column:
    """The size itself up to EXACT; above it, its 13 leading bits."""
    unit = F.pow(F.lit(2.0), F.length(F.bin(size)) - 13).cast("long")
    return F.when(size <= EXACT, size).otherwise(size - F.pmod(size, unit))


def deal(loads: list[float], classes: list[tuple[int, int, float]]) -> dict[int, list[int]]:
    """Shares {class: groups to each shard} for classes (class, number of groups, size of one), largest first; loads grows."""
    heap = [(load, i) for i, load in enumerate(loads)]
    heapq.heapify(heap)
    out = {}
    for key, count, size in classes:
        share = [0] * len(loads)
        if count > 4 * len(loads):
            active = [i for i in range(len(loads))]
            while True:  # the level that these groups fill the shards below it to
                level = (sum(loads[i] for i in active) + count * size) / len(active)
                below = [i for i in active if loads[i] < level]
                if len(below) == len(active):
                    break
                active = below
            for i in active:
                share[i] = max(0, int((level - loads[i]) / size) - 1)
                loads[i] += share[i] * size
            heap = [(load, i) for i, load in enumerate(loads)]
            heapq.heapify(heap)
        for _ in range(count - sum(share)):
            load, i = heapq.heappop(heap)
            share[i] += 1
            loads[i] = load + size
            heapq.heappush(heap, (loads[i], i))
        out[key] = share
    return out


def _number(rows: DataFrame, keys: list[str], order: list[str], spread: Column, name: str) -> DataFrame:
    """Gapless numbers from 0 within the keys, without a task that sees a whole key: ranks in buckets plus the buckets' offsets."""
    n = buckets(rows.sparkSession)
    rows = rows.withColumn("_b", F.pmod(spread, F.lit(n)).cast("int"))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*keys, "_b", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_from"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return ranked.join(before, [*keys, "_b"]).withColumn(name, (F.col("_r") + F.col("_from")).cast("long")).drop("_b", "_r", "_from")


def _spread(spark: SparkSession, groups: DataFrame, shares: dict[int, list[int]]) -> DataFrame:
    """groups (g, size, cls) with their shard: within a class the first of the numbered groups go to shard 0, and so on."""
    cuts = []
    for key, share in shares.items():
        total, ends = 0, []
        for n in share:
            total += n
            ends.append(total)
        cuts.append((key, ends))
    table = spark.createDataFrame(pd.DataFrame(cuts, columns=["cls", "ends"]), "cls long, ends array<long>")
    numbered = _number(groups, ["cls"], ["g"], F.xxhash64("g"), "n")
    return numbered.join(table, "cls").select("g", "size", F.size(F.filter("ends", lambda e: e <= F.col("n"))).alias("shard"))


def shard_groups(sizes: DataFrame, shards: int = 8) -> DataFrame:
    """sizes (g, size long > 0), one row a group -> (g, size, shard int)."""
    spark = sizes.sparkSession
    groups = stash(sizes.withColumn("cls", size_class(F.col("size"))), "groups")
    histogram = groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).orderBy(F.desc("cls")).collect()  # at most 65,536 + 4,096 * 48 rows
    loads = [0.0] * shards
    large = [(r.cls, r.n, r.total / r.n) for r in histogram if r.cls > EXACT]
    small = [(r.cls, r.n, float(r.cls)) for r in histogram if r.cls <= EXACT]
    out = None
    if large:
        out = stash(_spread(spark, groups.where(F.col("cls") > EXACT), deal(loads, large)), "large")
        loads = [0.0] * shards
        for r in out.groupBy("shard").agg(F.sum("size").alias("total")).collect():
            loads[r.shard] = float(r.total)
    if small:
        rest = _spread(spark, groups.where(F.col("cls") <= EXACT), deal(loads, small))
        out = rest if out is None else out.unionByName(rest)
    return out if out is not None else groups.select("g", "size", F.lit(0).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, group (hash of the text), shard, slot (gapless from 0 in the shard).

    Equal texts share a shard. size is the text's UTF-8 bytes plus 1.
    """
    text = F.col("text")
    rows = stash(
        only(docs, "doc_id", "text").select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(bytearray())).alias("g"),
        ),
        "sizes",
    )
    placed = stash(shard_groups(rows.groupBy("g").agg(F.sum("size").alias("size")), shards).select("g", "shard"), "homes")
    # both sides are tables of their own, so adaptive execution can split the rows of a group that many documents are in
    rows = stash(rows.join(placed, "g"), "placed")
    return _number(rows, ["shard"], ["doc_id", "text_crc32"], F.xxhash64("doc_id", "text_crc32"), "slot").withColumnRenamed("g", "group")
