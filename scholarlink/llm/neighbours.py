"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals, searched by bounds.

The index holds the direction and the length of every vector. The direction goes to the cell of its nearest coarse centroid;
its residual is coded by one of 256 codewords in each of PARTS parts, and what the code leaves is kept as a length. A query has a
floor from the start: its k-th best inner product with the sample below. It looks into every cell whose centroid, radius and lengths
let some vector reach that floor. Cells next to each other are searched together, in blocks of about BLOCK rows; a larger cell is cut
into several, and queries come in blocks as well, so no group is large. In a block the sums of a query's asymmetric
distance table over the codes, times the lengths, with what the codes may be wrong by, bound every vector's inner product. The `rerank` that promise
most are measured first, on the original vectors and in double precision; then all others whose bound reaches the k-th best of these. So
codes and cells decide how much is measured and not what is found, however the vectors lie.

Centroids and codewords are fitted on a sample of about SAMPLE vectors; the index holds every vector.

Nulls, empties, repeats: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without vec_id. Of rows that share a vec_id the smallest vector counts. Equal scores go by
vec_id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import fields, only, stash

SAMPLE, BLOCK, PARTS = 16_384, 20_000, 16


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    v = only(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usual = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return v.join(F.broadcast(usual), F.size("embedding") == F.col("n"), "left_semi")  # one row


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of x; at most as many as x has distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[k : k + 4096] @ c.T - half).argmax(axis=1) for k in range(0, len(x), 4096))])


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled first, so that squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1, keepdims=True)
    part = x / most
    length = np.sqrt((part * part).sum(axis=1))
    return (part / length[:, None]).astype(np.float32), length * most[:, 0]


class Codebook:
    def __init__(self, sample: np.ndarray, cells: int, parts: int):
        u, _ = directions(sample)
        self.centroids = kmeans(u, cells)
        cell = nearest(u, self.centroids)
        rest = u - self.centroids[cell]
        self.bounds = np.linspace(0, u.shape[1], min(parts, u.shape[1]) + 1).astype(int)
        self.words = [kmeans(rest[:, a:b], 256) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        self.slack = 1e-5 + 1.2e-7 * u.shape[1]  # more than single precision loses in an inner product of unit vectors

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, length and code of vectors; how far their directions are from the centroid and from what the code says."""
        u, length = directions(x)
        cell = nearest(u, self.centroids)
        rest = u - self.centroids[cell]
        code = np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.bounds[:-1], self.bounds[1:], self.words, strict=True)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([w[code[:, j]] for j, w in enumerate(self.words)], axis=1)
        return cell, length, code, np.linalg.norm(rest, axis=1), np.linalg.norm(left, axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """The asymmetric tables of queries, a row each: inner products of their parts with 256 codewords a part."""
        out = np.zeros((len(q), len(self.words), 256), np.float32)
        for j, (a, b, w) in enumerate(zip(self.bounds[:-1], self.bounds[1:], self.words, strict=True)):
            out[:, j, : len(w)] = q[:, a:b] @ w.T
        return out.reshape(len(q), -1)


class Sample:
    """Some of the rows, by which a query knows from the start what its k-th best has to reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        self.units, length = directions(x)
        self.lengths = np.minimum(length, np.finfo(float).max)

    def floors(self, ids: np.ndarray, units: np.ndarray, k: int, slack: float) -> np.ndarray:
        """The k-th largest inner product of each query's direction with other rows of the sample, less the slack; minus infinity if there are fewer."""
        if len(self.ids) < k:
            return np.full(len(ids), -np.inf)
        scores = (units @ self.units.T - slack) * self.lengths
        scores[ids[:, None] == self.ids] = -np.inf
        return np.partition(scores, -k, axis=1)[:, -k]


def train(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, cells: int | None = None) -> tuple[Codebook, Sample] | None:
    """A codebook and its sample, of about `sample` vectors, picked by a hash of vec_id, with `cells` cells (sqrt(n), 4,096 at most)."""
    n = vectors.count()
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / (1 << 30) * n < sample).orderBy("vec_id").toPandas()
    if not len(rows):
        rows = vectors.limit(1).toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["embedding"])
    return Codebook(x, cells or max(1, min(4096, int(n**0.5))), parts), Sample(rows["vec_id"].to_numpy(), x)


def _assign(vectors: DataFrame, shared) -> DataFrame:
    """vec_id, embedding, cell, length, code, away (from the centroid), off (from what the code says)."""
    schema = StructType([vectors.schema["vec_id"], vectors.schema["embedding"], *fields(cell="int", length="double", code=BinaryType(), away="double", off="double")])

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell, length, code, away, off = shared.value.encode(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(length), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(away, pa.float64()), pa.array(off, pa.float64())], names=schema.names)

    return vectors.mapInArrow(run, schema)


class Layout:
    """Which blocks hold which cells, and what there is in a cell: rows, the longest and the shortest vector, the direction farthest from the centroid."""

    def __init__(self, book: Codebook, sizes: np.ndarray, longest: np.ndarray, shortest: np.ndarray, radius: np.ndarray, block: int):
        self.sizes, self.longest, self.shortest, self.radius = sizes, longest, shortest, radius
        middle = book.centroids - book.centroids.mean(axis=0)
        along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]  # neighbouring cells share blocks
        self.first, self.parts, used, held = np.zeros(len(sizes), int), np.maximum(1, -(-sizes // block)), 0, 0
        for c in np.argsort(along, kind="stable").tolist():
            if held and held + sizes[c] > block:
                used, held = used + 1, 0
            self.first[c] = used
            held += int(sizes[c])
            if self.parts[c] > 1:
                used, held = used + int(self.parts[c]), 0

    def probed(self, book: Codebook, units: np.ndarray, floors: np.ndarray) -> list[np.ndarray]:
        """The cells that each query looks into: all that may hold a vector that reaches its floor."""
        most = units @ book.centroids.T + (self.radius + book.slack)
        most *= np.where(most > 0, self.longest, self.shortest)
        return [np.flatnonzero(row) for row in (most >= floors[:, None]) & (self.sizes > 0)]


def _probe(queries: DataFrame, shared, k: int) -> DataFrame:
    """query_id, vector, block, cells, floor: a row for each block that a query looks into, with its cells there."""
    schema = StructType([queries.schema["query_id"], queries.schema["vector"], *fields(block="int", cells=ArrayType(IntegerType()), floor="double")])

    def run(batches):
        book, sample, layout = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                units, _ = directions(np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1))
                floors = sample.floors(part.column(0).to_numpy(zero_copy_only=False), units, k, book.slack)
                owner, blocks, cells = [], [], []
                for nth, own in enumerate(layout.probed(book, units, floors)):
                    count = layout.parts[own]
                    block = np.repeat(layout.first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    of = np.repeat(own, count)
                    order = np.argsort(block, kind="stable")
                    for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                        owner.append(nth)
                        blocks.append(block[x[0]])
                        cells.append(of[x])
                of = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(blocks, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(floors).take(of)], names=schema.names)

    return queries.mapInArrow(run, schema)


def shortlist(near: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest finite values (the first of equals)."""
    short = np.flatnonzero(near > -np.inf)
    if len(short) > most:
        some = np.flatnonzero(near >= np.partition(near, -most)[-most])  # with all ties of the last
        short = some[np.argsort(-near[some], kind="stable")[:most]]
    return short


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 300, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """queries (query_id, vector) against vectors (vec_id, embedding), both as usable() gives them -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors = stash(vectors, "vectors")
    fitted = train(vectors, cells=cells)
    if fitted is None:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    book, sample = fitted
    coded = spark.sparkContext.broadcast(book)  # at most 4,096 centroids and 256 codewords a part
    index = stash(_assign(vectors, coded), "index")
    sizes, (longest, shortest, radius) = np.zeros(len(book.centroids), int), np.zeros((3, len(book.centroids)))
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.max("away").alias("away")).collect():  # at most 4,096 cells
        sizes[r.cell], longest[r.cell], shortest[r.cell], radius[r.cell] = r.n, r.longest, r.shortest, r.away
    layout = Layout(book, sizes, longest, shortest, radius, block)
    shared = spark.sparkContext.broadcast((book, sample, layout))  # the sample is of a fixed size
    places = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(sizes), dtype=np.int32), "first": layout.first.astype(np.int32), "parts": layout.parts.astype(np.int32)}), "cell int, first int, parts int")
    queries = stash(queries, "queries")
    n_q = max(1, -(-queries.count() // block))
    turn = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q")  # a copy of the index for each block of queries
    there = index.join(F.broadcast(places), "cell").select("vec_id", "embedding", "cell", "length", "code", "off", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts"))).cast("int").alias("block"), turn)
    asked = _probe(queries, shared, k).withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(n_q)).cast("int"))
    schema = StructType([queries.schema["query_id"], *fields(vec_id="long", score="double")])

    def look(asked, there):
        own, found, scores = [], [], []
        if len(asked) and len(there):
            book, _, _ = shared.value
            there = there.sort_values("vec_id")
            ids, x, cell, length, off = there["vec_id"].to_numpy(), np.stack(there["embedding"]), there["cell"].to_numpy(), there["length"].to_numpy(), there["off"].to_numpy() + book.slack
            code = np.frombuffer(b"".join(there["code"]), np.uint8).reshape(len(there), -1).astype(np.int32) + 256 * np.arange(len(book.words), dtype=np.int32)
            for at in range(0, len(asked), 200):
                some = asked.iloc[at : at + 200]
                q = np.stack(some["vector"])
                units, size = directions(q)
                tables, base = book.tables(units), units @ book.centroids.T
                for r, (query, wanted, floor) in enumerate(zip(some["query_id"].tolist(), some["cells"], some["floor"], strict=True)):
                    inside = np.zeros(len(book.centroids), bool)
                    inside[wanted] = True
                    near = tables[r][code].sum(axis=1) + base[r][cell]
                    most = (near + off) * length
                    fit = inside[cell] & (ids != query) & (most >= floor)
                    short = shortlist(np.where(fit, near * length, -np.inf), max(rerank, k))
                    exact = (x[short] * q[r]).sum(axis=1)
                    if len(exact) > k:  # of the others, those that may still be as near as the k-th
                        fit[short] = False
                        rest = np.flatnonzero(fit & (most * size[r] >= np.partition(exact, -k)[-k]))
                        short, exact = np.concatenate([short, rest]), np.concatenate([exact, (x[rest] * q[r]).sum(axis=1)])
                    best = np.lexsort((ids[short], -exact))[:k]
                    own += [query] * len(best)
                    found += ids[short][best].tolist()
                    scores += exact[best].tolist()
        return pd.DataFrame({"query_id": pd.Series(own, dtype="int64"), "vec_id": pd.Series(found, dtype="int64"), "score": pd.Series(scores, dtype="float64")})

    best = asked.groupBy("block", "q").cogroup(there.groupBy("block", "q")).applyInPandas(look, schema)
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
