"""Exact top-k search by inner product: KD-trees per shard, best-first traversal and a propagated kth distance.

Components become integers, floor(scale * x), so scores are exact. A coarse KD-tree over a bounded sample (SAMPLE vectors, picked by a hash of vec_id)
deals all vectors into regions, 4,096 at most; a region of more than `rows` vectors is dealt into several shards by a hash, so a vector that
a third of all rows hold is no group of its own. Each shard builds a KD-tree by median splits of its widest dimension, with a
tight bounding box and the smallest vec_id at every node. The bound of a box is the largest inner product that a vector in it could have.

A query first searches one shard of the region with the best bound. Its kth score (and the vec_id there, for ties) goes along to the
others: only regions whose box may still hold something better are visited, and within a shard nodes are taken best bound first until none
can improve the k best. Queries that come to the same leaf at the same time are measured by one matrix product. The result is
exact whatever the data; how much is skipped depends on them. In many dimensions without clusters the boxes of most regions reach further than the kth
score and nearly all rows are measured, as by any exact method. A region is cut off by its own box and nothing else: no row is dropped or sampled.

Queries come in blocks of at most BLOCK to a shard, so neither side of a group is large; every block gets its own copy of a shard, which costs
less than measuring it does. With queries a share of the rows the work is quadratic in them by definition.

Nulls, empties, repeats: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. Shorter
vectors count as filled up with zeros; a vector of no components scores 0. Of rows that share a vec_id the smallest vector counts.
Equal scores go by vec_id. Scores beyond a long's range count as the nearest long. Empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import buckets, fields, only, stash

SAMPLE, REGIONS, ROWS, BLOCK, LEAF = 16_384, 4_096, 20_000, 20_000, 256
#: Below this, sums of products of integers are exact in double precision.
EXACT = 2.0**53
LONG = 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part, one a vec_id, all of the longest one's length."""
    v = only(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("vec_id", F.col("vec_id").cast("long"))
    v = stash(v.where(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    longest = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    missing = F.lit(longest) - F.size("embedding")
    return v.withColumn("embedding", F.when(missing > 0, F.concat("embedding", F.array_repeat(F.lit(0.0), missing))).otherwise(F.col("embedding")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows."""
    n = len(column)
    flat = np.concatenate([np.asarray(c.flatten()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [np.zeros(0)])
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold integers, or Python's integers where doubles would overflow."""
    with np.errstate(over="ignore"):
        out = np.floor(x * scale)
    if np.isfinite(out).all():
        return out
    big = np.abs(x) >= EXACT  # such a double is an integer already
    return np.where(big, np.array([int(v) * scale if b else 0 for v, b in zip(x.ravel(), big.ravel(), strict=True)], object).reshape(x.shape), np.where(big, 0, out))


def comparable(q: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as doubles if all inner products of q with the others stay exact, else as Python's integers."""
    most = lambda a: float(min(np.abs(a).max(), 10**150)) if a.size else 0.0
    if most(q) * max(most(a) for a in others) * max(1, q.shape[-1]) < EXACT:
        return tuple(a.astype(np.float64) for a in (q, *others))
    return tuple(np.array([int(v) for v in a.ravel()], object).reshape(a.shape) for a in (q, *others))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, within a long's range."""
    out = a @ b.T
    return np.clip(out, -LONG - 1, LONG) if out.dtype == object else out


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries by boxes: the largest inner product with a point of the box."""
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return np.clip(out, -LONG - 1, LONG) if out.dtype == object else out


class KDTree:
    """Rows in the order of the leaves; for each node its range of rows, children (-1: a leaf), tight box and smallest id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int):
        order = np.argsort(ids, kind="stable")
        spans, children, low, high, least = [(0, len(ids))], [(-1, -1)], [], [], []
        at = 0
        while at < len(spans):  # nodes come in the order in which they are cut
            start, stop = spans[at]
            rows = order[start:stop]
            low.append(x[rows].min(axis=0))
            high.append(x[rows].max(axis=0))
            least.append(ids[rows].min())
            if stop - start > leaf:
                wide = high[-1] - low[-1]
                if x.shape[1] and wide.max() > 0:
                    axis = int(wide.argmax())
                    order[start:stop] = rows[np.argsort(x[rows, axis], kind="stable")]
                else:  # all alike: smaller ids first
                    order[start:stop] = rows[np.argsort(ids[rows], kind="stable")]
                middle = (start + stop) // 2
                children[at] = (len(spans), len(spans) + 1)
                spans += [(start, middle), (middle, stop)]
                children += [(-1, -1), (-1, -1)]
            at += 1
        self.ids, self.x, self.spans, self.children, self.least = ids[order], x[order], spans, children, least
        self.low, self.high = np.stack(low), np.stack(high)


class Best:
    """The k best of one query so far; what comes in has to beat `score`, or equal it with a smaller id than `last`."""

    __slots__ = ("ids", "k", "last", "score", "scores")

    def __init__(self, k: int, score, last):
        self.k, self.score, self.last, self.scores, self.ids = k, score, last, np.zeros(0), np.zeros(0, np.int64)

    def beaten_by(self, bound, least) -> bool:
        return self.score is None or bound > self.score or (bound == self.score and least < self.last)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.score is not None:
            fine = (scores > self.score) | ((scores == self.score) & (ids < self.last))
            scores, ids = scores[fine], ids[fine]
        if not len(ids):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r]))[: self.k])
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.score, self.last = self.scores[-1], self.ids[-1]


def traverse(tree: KDTree, queries: np.ndarray, own: np.ndarray, best: list[Best]) -> int:
    """Best-first search of all queries, each but its own id. Returns how many rows were measured."""
    bounds, measured = box_bounds(queries, tree.low, tree.high), 0
    heaps = [[(-bounds[i, 0], tree.least[0], 0)] for i in range(len(best))]
    active = list(range(len(best)))
    while active:
        at_leaf = defaultdict(list)
        for i in active:
            heap, mine = heaps[i], best[i]
            while heap:
                bound, least, node = heappop(heap)
                if not mine.beaten_by(-bound, least):
                    if -bound < mine.score:  # so are all that follow
                        heap.clear()
                    continue
                left, right = tree.children[node]
                if left < 0:
                    at_leaf[node].append(i)
                    break
                for child in (left, right):
                    if mine.beaten_by(bounds[i, child], tree.least[child]):
                        heappush(heap, (-bounds[i, child], tree.least[child], child))
        active = []
        for node, members in at_leaf.items():
            start, stop = tree.spans[node]
            scores, ids = products(queries[members], tree.x[start:stop]), tree.ids[start:stop]
            measured += scores.size
            for row, i in zip(scores, members, strict=True):
                other = ids != own[i]
                best[i].add(row[other], ids[other])
            active += [i for i in members if heaps[i]]
    return measured


class Regions:
    """A coarse KD-tree: median splits of a sample into at most `most` regions."""

    def __init__(self, x: np.ndarray, most: int):
        self.axis, self.cut, self.children, self.region = [], [], [], []
        heap, count = [(-len(x), 0, np.arange(len(x)))], 1
        self._leaf()
        while heap and count < most:
            _, node, rows = heappop(heap)
            wide = np.ptp(x[rows], axis=0) if x.shape[1] and len(rows) > 1 else np.zeros(1)
            if wide.max() <= 0:
                continue
            axis = int(wide.argmax())
            values = np.sort(x[rows, axis])
            cut = values[len(values) // 2]
            cut = cut if cut > values[0] else values[np.searchsorted(values, cut, "right")]  # both sides get rows
            self.axis[node], self.cut[node] = axis, cut
            for side in (rows[x[rows, axis] < cut], rows[x[rows, axis] >= cut]):
                heap_node = self._leaf()
                self.children[node].append(heap_node)
                heappush(heap, (-len(side), heap_node, side))
            count += 1
        self.leaves = [n for n, c in enumerate(self.children) if not c]
        for k, n in enumerate(self.leaves):
            self.region[n] = k

    def _leaf(self) -> int:
        self.axis.append(0)
        self.cut.append(0.0)
        self.children.append([])
        self.region.append(-1)
        return len(self.axis) - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.region[node]
            elif len(rows):
                below = x[rows, self.axis[node]] < self.cut[node]
                todo += [(self.children[node][0], rows[below]), (self.children[node][1], rows[~below])]
        return out


def _assign(vectors: DataFrame, shared) -> DataFrame:
    """vec_id, embedding, region."""
    schema = StructType([vectors.schema["vec_id"], vectors.schema["embedding"], *fields(region="int")])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.of(matrix(b.column(1))), pa.int32())], names=schema.names)

    return vectors.mapInArrow(run, schema)


class Map:
    """Of each region that holds rows: box, smallest id, first shard and number of shards."""

    def __init__(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, parts: np.ndarray):
        self.low, self.high, self.least, self.parts = low, high, least, parts
        self.first = np.cumsum(parts) - parts

    def shards(self, regions: np.ndarray) -> np.ndarray:
        """All shards of some regions."""
        count = self.parts[regions]
        return np.repeat(self.first[regions] - np.cumsum(count) + count, count) + np.arange(count.sum())


def _route(queries: DataFrame, shared) -> DataFrame:
    """queries (query_id, vector, home, score, last) with a shard each: without a home one of the best region's, else all of the regions that may hold better ones, but for the home."""
    schema = StructType([*queries.schema.fields, *fields(shard="int")])

    def run(batches):
        there, scale = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                q, low, high = comparable(integers(matrix(part.column(1)), scale), there.low, there.high)
                bounds = box_bounds(q, low, high)
                for i, (query, home, score, last) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                    if home is None:
                        best = int(bounds[i].argmax())
                        shards = there.first[[best]] + query % there.parts[[best]]
                    else:
                        fine = np.ones(len(there.least), bool) if score is None else ((bounds[i] > score) | ((bounds[i] == score) & (there.least < last))).astype(bool)
                        shards = there.shards(np.flatnonzero(fine))
                        shards = shards[shards != home]
                    for k in range(0, len(shards), 1000):
                        some = shards[k : k + 1000]
                        rows = pa.array(np.full(len(some), i))
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in range(5)), pa.array(some, pa.int32())], names=schema.names)

    return queries.mapInArrow(run, schema)


def _look(asked: DataFrame, index: DataFrame, blocks: int, k: int, scale: int, leaf: int) -> DataFrame:
    """asked (query_id, vector, home, score, last, shard) in the shards of index (vec_id, embedding, shard) -> query_id, vec_id, score, shard."""
    schema = StructType(fields(query_id="long", vec_id="long", score="long", shard="int"))
    types = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int32())])

    def look(key, asked, there):
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asked.num_rows and there.num_rows:
            q, x = comparable(integers(matrix(asked.column("vector")), scale), integers(matrix(there.column("embedding")), scale))
            tree = KDTree(there.column("vec_id").to_numpy(), x, leaf)
            own, score, last = asked.column("query_id").to_numpy(), asked.column("score").to_pylist(), asked.column("last").to_pylist()
            for at in range(0, len(q), 1000):
                some = slice(at, at + 1000)
                best = [Best(k, *limit) for limit in zip(score[some], last[some], strict=True)]
                traverse(tree, q[some], own[some], best)
                for query, b in zip(own[some], best, strict=True):
                    for out, values in zip(found, (np.full(len(b.ids), query), b.ids, b.scores.astype(np.int64)), strict=True):
                        out.append(values)
        rows = [np.concatenate(f) for f in found]
        return pa.table([*rows, np.full(len(rows[0]), key[0].as_py(), np.int32)], schema=types)

    block = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block")
    copies = index.select("vec_id", "embedding", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return asked.select("*", block).groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(look, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, rows: int = ROWS, leaf: int = LEAF, regions: int = REGIONS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """queries (query_id, vector) against vectors (vec_id, embedding), both as usable() gives them -> query_id, rank, vec_id, score: the k best, exactly."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], StructType(fields(query_id="long", rank="int", vec_id="long", score="long")))
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    rows = max(1, min(rows, max(1000, n // (2 * buckets(spark)))))  # several shards for each core where there are rows enough
    some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30) * n < sample).orderBy("vec_id").toPandas()
    some = some if len(some) else vectors.limit(1).toPandas()
    coarse = Regions(np.stack(some["embedding"]), min(regions, -(-n // rows), max(1, 262_144 // max(1, width))))
    index = stash(_assign(vectors, spark.sparkContext.broadcast(coarse)), "regions")  # at most 4,096 cuts
    held = index.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).orderBy("region").toPandas()  # at most 4,096 rows
    sides = index.select("region", F.posexplode("embedding").alias("pos", "x")).groupBy("region", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("region", "pos").toPandas()  # at most 262,144 rows
    low, high = (integers(sides[c].to_numpy().reshape(len(held), width), scale) for c in ("low", "high"))
    there = Map(low, high, held["least"].to_numpy(), -(-held["n"].to_numpy() // rows))
    shared = spark.sparkContext.broadcast((there, scale))
    places = spark.createDataFrame(pd.DataFrame({"region": held["region"].to_numpy(), "first": there.first, "parts": there.parts}), "region int, first long, parts long")
    index = index.join(F.broadcast(places), "region").select("vec_id", "embedding", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts"))).cast("int").alias("shard"))
    queries = stash(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), "queries")
    blocks = max(1, -(-queries.count() // block))

    fresh = queries.select("query_id", "vector", F.lit(None).cast("int").alias("home"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("last"))
    near = stash(_look(_route(fresh, shared), index, blocks, k, scale, leaf), "near")
    worst = F.min(F.struct("score", (-F.col("vec_id")).alias("minus")))
    kth = near.groupBy("query_id").agg(F.max("shard").alias("home"), F.count(F.lit(1)).alias("n"), worst.alias("worst"))
    full = F.col("n") >= k
    again = queries.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce("home", F.lit(-1)).alias("home"), F.when(full, F.col("worst.score")).alias("score"), F.when(full, -F.col("worst.minus")).alias("last"))
    found = near.unionByName(_look(_route(again, shared), index, blocks, k, scale, leaf))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
