"""Benchmark decontamination with an FM-index per shard of training text.

A shard is the run of documents that one task holds at a time. Its words become a sequence over the benchmark's own
vocabulary; a run of words outside it can hold no benchmark phrase and shrinks to one separator, so the index covers the
stretches that could. Over that sequence the suffix array gives the Burrows-Wheeler transform, a wavelet tree answers ranks
on it, every benchmark phrase is searched backwards, its occurrences are located from sampled suffix positions, and their
spans are merged to what has to be removed.

The phrases go to the tasks in blocks of at most BLOCK_WORDS words: a larger benchmark takes several passes over the shards.

Nulls, empties, repeats: a null or wordless text has no words and no hits; a null or wordless item has no phrase. Rows
that repeat are reported as often as they come. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import fields, only

#: Words are what is left of lower-cased (A-Z only) text between these bytes: all of ASCII but digits and letters.
BREAKS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
TABLE = bytes(0x20 if bytes([b]).lower()[0] in BREAKS else bytes([b]).lower()[0] for b in range(256))
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 2_000_000
SAMPLE = 16
FOUND = StructType(fields(n_words="long", n_hit="long", items="strings", spans=ArrayType(StructType(fields(start="long", stop="long")))))



def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; s ends in a value that occurs nowhere else."""
    rank, n, h = s.astype(np.int64), len(s), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class WaveletTree:
    """Ranks over a sequence of small integers: one level of bits for each bit of the values, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often value[k] occurs among the first i[k] entries."""
        start = np.zeros_like(i)
        for level, b in enumerate(reversed(range(self.bits))):
            one, ones, zeros = ((value >> b) & 1).astype(bool), self.ones[level], self.zeros[level]
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """Counts and locates phrases in a sequence of integers >= 1."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE):
        s = np.append(sequence, 0)
        sa = suffix_array(s)
        self.n, self.bwt = len(s), s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=int(s.max()) + 2))])
        self.tree = WaveletTree(self.bwt, max(1, int(s.max()).bit_length()))
        self.sampled = sa % sample == 0
        self.kept = np.where(self.sampled, sa, 0)[self.sampled]
        self.which = np.cumsum(self.sampled) - 1
        self.top = int(s.max())

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: a row each, all of one length -> the ranges [lo, hi) of suffixes that start with them."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases <= self.top).all(axis=1)) if len(phrases) else np.zeros(0, np.int64)
        hi[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            lo[alive] = self.before[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of these suffixes: step back until a sampled one."""
        rows, out, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            out[open_[done]] = self.kept[self.which[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            c = self.bwt[at]
            rows[open_] = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The benchmark's phrases: every window of `window` words of an item, or the whole item if it has fewer."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]  # 1 separates stretches
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[set[str]]]] = {}
        for n in {len(p) for p in found}:
            rows = [p for p in found if len(p) == n]
            self.by_length[n] = np.array(rows, np.int64).reshape(-1, n), [found[p] for p in rows]
        self.shortest = min(self.by_length, default=0)


def _stretches(ids: np.ndarray, owner: np.ndarray, shortest: int) -> np.ndarray:
    """Indices of words in runs, within a document, of at least `shortest` words of the vocabulary."""
    known = ids > 0
    edge = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])])) if len(ids) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(edge, len(ids)))
    return np.flatnonzero(np.repeat(known[edge] & (lengths >= shortest), lengths))


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text: words, words hit, items found (sorted), merged spans of word positions."""
    lengths, parts, get = [], [], phrases.vocabulary.get
    for t in texts:
        w = words_of(t)
        lengths.append(len(w))
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    cover, items = np.zeros(len(ids) + 1, np.int64), {}
    keep = _stretches(ids, owner, phrases.shortest)
    if len(keep):
        cut = np.flatnonzero((np.diff(keep) != 1) | (np.diff(owner[keep]) != 0)) + 1
        sequence = np.insert(ids[keep], cut, 1)
        place = np.insert(keep, cut, -1)
        index = FMIndex(sequence)
        for n, (rows, holders) in phrases.by_length.items():
            lo, hi = index.search(rows)
            hits = np.flatnonzero(hi > lo)
            spans = hi[hits] - lo[hits]
            which = np.repeat(hits, spans)
            suffixes = np.repeat(lo[hits] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            at = place[index.locate(suffixes)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            for pair in np.unique(owner[at] * len(rows) + which) if len(at) else ():
                items.setdefault(int(pair // len(rows)), set()).update(holders[int(pair % len(rows))])
    hit = np.cumsum(cover[:-1]) > 0
    ends = np.cumsum(lengths)
    out = []
    for k, n in enumerate(lengths):
        mine = hit[ends[k] - n : ends[k]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))) if k in items else []
        out.append((n, int(mine.sum()), sorted(items.get(k, ())), list(zip(map(int, edge[::2]), map(int, edge[1::2]), strict=True))))
    return out


def _blocks(benchmark: DataFrame, limit: int):
    """The items with words, in blocks of at most `limit` words (an item more than that is a block by itself)."""
    block, size = [], 0
    for r in only(benchmark, "item_id", "text").where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        words = words_of(r.text)
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, words))
        size += len(words)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids found, sorted) and spans (merged word positions to remove); other columns stay.

    One narrow pass without a shuffle for each block of phrases. Columns of docs with these four names are replaced.
    """
    out = docs.drop(*[f.name for f in FOUND.fields])
    for k, items in enumerate(_blocks(benchmark, block_words)):
        out = _pass(out, docs.sparkSession.sparkContext.broadcast(Phrases(items, window)), again=k > 0)  # at most block_words words
    return out


def _pass(df: DataFrame, phrases, again: bool) -> DataFrame:
    base = [n for n in df.columns if n not in FOUND.names]
    schema = StructType([f for f in df.schema.fields if f.name in base] + FOUND.fields)

    def search(batches):
        for batch in batches:
            for part in _cut(batch):
                of = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                found = search_shard(of["text"].to_pylist(), phrases.value)
                if again:
                    found = [_merge(*x) for x in zip(found, of["items"].to_pylist(), of["spans"].to_pylist(), strict=True)]
                columns = [pa.array([x[k] for x in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.string())))]
                spans = pa.array([[{"start": a, "stop": b} for a, b in x[3]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([of[n] for n in base] + [*columns, spans], names=base + FOUND.names)

    return df.mapInArrow(search, schema)


def _cut(batch: pa.RecordBatch):
    """Slices of a batch that hold about SHARD_WORDS words (five bytes a word at least, with its blank); one document at least."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index("text"))).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > SHARD_WORDS * 5:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _merge(new, items, spans):
    """What two passes over one document found, together."""
    cover = sorted([*new[3], *((s["start"], s["stop"]) for s in spans)])
    merged: list[tuple[int, int]] = []
    for a, b in cover:
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return new[0], sum(b - a for a, b in merged), sorted({*new[2], *items}), merged
