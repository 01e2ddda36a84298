"""What the operators of this subpackage share: the scratch store and small column helpers."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField

from ..operators.store import shared_folder

KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "double": DoubleType(), "boolean": BooleanType(), "longs": ArrayType(LongType()), "strings": ArrayType(StringType())}

#: The ASCII white space that separates words: U+0020 and U+0009 to U+000D. bytes.split() cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns can't clash with those an operator makes."""
    return docs.select(*[docs[n] for n in names])


def fields(**kinds: str | DataType) -> list[StructField]:
    return [StructField(n, KINDS[k] if isinstance(k, str) else k) for n, k in kinds.items()]


def buckets(spark: SparkSession) -> int:
    """How many buckets to spread numbering over: as many as shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


SEGMENT = 1 << 16
BASE = 0xD6E8FEB86659FD93
_random = np.random.default_rng(17)
#: A random 64-bit value for each byte; the powers of BASE, and those of its inverse, modulo 2**64.
_VALUES = _random.integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(SEGMENT, BASE, np.uint64))
    _INVERSE = np.cumprod(np.full(SEGMENT, pow(BASE, -1, 1 << 64), np.uint64))


def _segment(a: np.ndarray) -> np.ndarray:
    """Word hashes of at most SEGMENT bytes, words and white space."""
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[a] * _POWERS[: len(a)])])
        return (sums[ends] - sums[starts]) * _INVERSE[starts]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: polynomials over random values of their bytes, all words at once."""
    a = np.frombuffer(text, np.uint8)
    if len(a) <= SEGMENT:
        return _segment(a)
    out, at = [], 0
    while at < len(a):
        stop = min(at + SEGMENT, len(a))
        blank = np.flatnonzero(_SPACE[a[at:stop]])
        if stop == len(a) and stop - at < SEGMENT or len(blank):
            stop = stop if stop == len(a) else at + int(blank[-1]) + 1
            out.append(_segment(a[at:stop]))
        else:  # a word of more than a segment, in parts
            total, factor = 0, 1
            while at < len(a) and not _SPACE[a[at]]:
                blank = np.flatnonzero(_SPACE[a[at : at + SEGMENT]])
                stop = at + (int(blank[0]) if len(blank) else min(SEGMENT, len(a) - at))
                total += int(_segment(a[at:stop])[0]) * factor
                factor, at = factor * pow(BASE, stop - at, 1 << 64) % (1 << 64), stop
            out.append(np.array([total % (1 << 64)], np.uint64))
        at = stop
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of 64-bit word hashes; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h ^= words[j : j + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)
