"""Quality of documents by ordinal regression: a cumulative-link model on graded ratings.

A text has the hashed presence of its lower-cased words. One vector of weights gives it a score, and ordered thresholds cut
the scores into grades: P(grade <= k) = sigmoid(threshold[k] - score). The model gives the expected grade and the tail
probabilities P(grade >= k) that selection goes by. Weights are fitted by proximal AdaGrad with an L1 penalty, on a bounded
sample of about `sample` rated documents, picked by a hash of doc_id.

Nulls, empties, repeats: a null or wordless text has no features and gets what the thresholds alone say. Ratings with a null
doc_id or grade teach nothing; of several for one document the lowest counts. Without any rating all grades are 0 and
nothing is rejected. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import fields, only

BITS = 18
STRIP = ".,;:!?\"'()[]"


def presence(text: str | None) -> list[int]:
    """Distinct hashes of the words of a text."""
    return [] if text is None else list({zlib.crc32(w.strip(STRIP).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in set(text.lower().split())})


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Shared weights and ordered thresholds for grades 0 to len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[list[int]], grades: list[int], rounds: int = 300, rate: float = 0.3, l1: float = 0.016, l2: float = 1e-6) -> Ordinal:
    y = np.asarray(grades, int)
    top = int(y.max()) if len(y) else 0
    weights = np.zeros(1 << BITS)
    if not top:
        return Ordinal(weights, np.zeros(0))
    own, ids = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.asarray(r, np.int64) for r in rows])
    below = np.array([(y < k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(top))
    gaps = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])  # the first threshold, logs of the steps
    l1 /= len(rows) ** 0.5  # the more rated texts, the less a weight has to prove
    squares, squares_g = np.full(len(weights), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        s = np.bincount(own, weights[ids], minlength=len(rows))
        upper = np.where(y < top, sigmoid(theta[np.minimum(y, top - 1)] - s), 1.0)
        lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g = np.bincount(ids, ((du - dl) / len(rows))[own], minlength=len(weights)) + l2 * weights
        squares += g * g
        step = rate / np.sqrt(squares)
        w = weights - step * g
        weights = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        gt = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(rows) for k in range(top)])
        gg = np.cumsum(gt[::-1])[::-1] * np.concatenate([[1.0], np.exp(gaps[1:])])
        squares_g += gg * gg
        gaps -= rate * gg / np.sqrt(squares_g)
    return Ordinal(weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def learn(docs: DataFrame, ratings: DataFrame, sample: int = 12_000) -> Ordinal:
    """Fit on about `sample` of the documents that ratings (doc_id, grade) covers."""
    ratings = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / (1 << 30)
    rated = ratings.where(share * ratings.count() < sample)  # about `sample` rows, whatever the corpus

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([presence(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "grade", "ids"])

    rows = only(docs, "doc_id", "text").join(F.broadcast(rated), "doc_id").select("doc_id", "grade", "text")
    rows = rows.mapInArrow(hashed, StructType([rows.schema["doc_id"], *fields(grade="int", ids="longs")])).toPandas().sort_values("doc_id")
    return fit(rows["ids"].tolist(), rows["grade"].tolist())


def grade(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with expected_grade and tails (P(grade >= 1), P(grade >= 2), ...)."""
    base = [n for n in docs.columns if n not in ("expected_grade", "tails")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    schema = StructType([docs.schema[n] for n in base] + fields(expected_grade="double", tails=ArrayType(DoubleType())))

    def run(batches):
        m, seen = shared.value, {}
        weight = m.weights.tolist()
        for b in batches:
            scores = np.zeros(b.num_rows)
            for k, text in enumerate(b.column(base.index("text"))):
                if len(seen) > 300_000:
                    seen.clear()
                text, ids = text.as_py(), set()
                for w in set(text.lower().split()) if text else ():
                    i = seen.get(w)
                    if i is None:
                        i = seen[w] = zlib.crc32(w.strip(STRIP).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
                    ids.add(i)
                scores[k] = sum(map(weight.__getitem__, sorted(ids)))
            tails = m.tails(scores)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in range(len(base))), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*base).mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 toxic, 1 neither toxic nor good, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))
