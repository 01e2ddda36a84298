"""Substring dedup: passages of `window` or more words that recur, found by sharded Aho-Corasick automata.

Equal texts count once, for their first document: of a later copy every window starts there, so all its words go if it has
a window at all. For the different texts:

1. Anchors. Of every `window` consecutive words the GRAM-word phrase of least hash is the anchor, wherever the window
   stands, so a window that two documents share has one anchor in both.
2. Confirmation. Windows whose anchor recurs are compared by a 128-bit hash; those that start in several documents are
   confirmed, with the first document of each. Runs of them in their first document are the passages.
3. Automata. Passages are dealt to shards by their document. A shard compiles half-window phrases, every half window, with
   pyahocorasick; each window of a passage holds a whole one.
4. Streaming. The stretches of documents that share windows with a shard's passages stream through its automaton; every
   occurrence is extended, word by word, as far as passage and document agree. Agreements of a window or more with an
   earlier document are removed. A shard that many stretches visit has copies of its automaton.

Nulls, empties, repeats: a null text has no words. Documents without doc_id come neither before nor after another and keep all
words. Rows that share a doc_id are one document. Texts of fewer words than a window stay as they are. Empty tables give
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import fields, gram_hashes, only, stash

GRAM = 16
#: Words of a stretch, bytes of passages a shard, stretches a copy of a shard.
STRETCH, SHARD, VISITS = 2_000, 1_000_000, 2_000


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `width` neighbouring grams the place of the least (the leftmost of equals): those places, and how many neighbourhoods, one after the other, each stands for."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, done = np.arange(len(grams)), 1
    while done < width:
        step = min(done, width - done)
        left, right = place[:-step], place[step:]
        place = np.where(grams[left] <= grams[right], left, right)
        done += step
    return np.unique(place, return_counts=True)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, fp, h, lo, hi): anchors with the first and last start of the windows that each stands for."""
    schema = StructType([docs.schema["doc_id"], docs.schema["fp"], *fields(h="long", lo="int", hi="int")])

    def run(batches):
        for b in batches:
            own, hs, lo, hi = [], [], [], []
            for k, text in enumerate(b.column(2)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    g = gram_hashes(hashed(words), GRAM)
                    at, n = anchors(g, window - GRAM + 1)
                    stop = np.cumsum(n)
                    own.append(np.full(len(at), k))
                    hs.append(g[at].view(np.int64))
                    lo.append(stop - n)
                    hi.append(stop - 1)
            if own:
                own = pa.array(np.concatenate(own))
                columns = [pa.array(np.concatenate(hs)), pa.array(np.concatenate(lo), pa.int32()), pa.array(np.concatenate(hi), pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *columns], names=schema.names)

    return docs.select("doc_id", "fp", "text").where("doc_id is not null").mapInArrow(run, schema)


def stretches(starts: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Word ranges that hold just the windows that start in these ranges (first, last), cut to STRETCH words; cuts overlap by a window less a word."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    step = STRETCH - window + 1
    return [(a, min(hi + window, a + STRETCH)) for lo, hi in out for a in range(lo, hi + 1, step)]


def _prepared(docs: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """Each document with n_words, the hash of its words and its code; those near recurring anchors also with text and stretches."""
    listed = recurring.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))  # fewer than the document's words
    joined = docs.join(listed, ["doc_id", "fp"], "left").select("doc_id", "fp", "text", "at", "code")
    stretch = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.string())]))
    schema = StructType([docs.schema["doc_id"], docs.schema["fp"], *fields(n_words="long", whole="string", text="string"), *_stretch_field(), docs.schema["code"]])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts, n, whole, cut = part.column(2).to_pylist(), [], [], []
                for text, at in zip(texts, part.column(3).to_pylist(), strict=True):
                    words = words_of(text)
                    n.append(len(words))
                    whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    cut.append([{"start": x, "words": b" ".join(words[x:y]).decode()} for x, y in stretches([(r["lo"], r["hi"]) for r in at], window)] if at else None)
                kept = pa.array([t if c else None for t, c in zip(texts, cut, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(whole), kept, pa.array(cut, stretch), part.column(4)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _stretch_field():
    return fields(stretches=ArrayType(StructType(fields(start="int", words="string"))))


def _windows(pieces: DataFrame, window: int) -> DataFrame:
    """(doc_id, piece, w1, w2, s): each distinct window of each stretch, where it first is."""
    schema = StructType([pieces.schema["doc_id"], *fields(piece="long", w1="long", w2="long", s="int")])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                own, one, two, at = [], [], [], []
                for k, text in enumerate(part.column(2)):
                    h = hashed(words_of(text.as_py()))
                    w, first = np.unique(gram_hashes(h, window), return_index=True)
                    own.append(np.full(len(w), k))
                    one.append(w)
                    two.append(gram_hashes(h[::-1], window)[::-1][first])
                    at.append(first)
                own = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(np.concatenate(at), pa.int32())], names=schema.names)

    return pieces.select("doc_id", "piece", "words").mapInArrow(run, schema)


def _passages(pieces: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(doc_id, words): runs of source windows (piece, s) of a stretch."""
    listed = sources.groupBy("piece").agg(F.array_sort(F.collect_set("s")).alias("s"))  # at most STRETCH
    schema = StructType([pieces.schema["doc_id"], *fields(words="string")])

    def run(batches):
        for b in batches:
            own, out = [], []
            for k, (text, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                words, s = text.split(" "), np.array(s)
                for x in np.split(s, np.flatnonzero(np.diff(s) != 1) + 1):
                    own.append(k)
                    out.append(" ".join(words[x[0] : x[-1] + window]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(out, pa.string())], names=schema.names)

    return pieces.join(listed, "piece").select("doc_id", "words", "s").mapInArrow(run, schema)


class Automaton:
    """The passages of a shard, ready to be found again."""

    def __init__(self, passages: list[tuple[int, str]], window: int):
        import ahocorasick

        self.window, self.passages = window, [(doc, p.split(" ")) for doc, p in passages]
        half, found = window // 2, {}
        for k, (_, words) in enumerate(self.passages):
            for at in range(0, len(words) - half + 1, half):
                found.setdefault(" " + " ".join(words[at : at + half]) + " ", []).append((k, at))
        self.trie = ahocorasick.Automaton()
        for phrase, places in found.items():
            self.trie.add_word(phrase, (len(phrase), places))
        if found:
            self.trie.make_automaton()
        self.any = bool(found)

    def agreements(self, doc: int, text: str) -> list[tuple[int, int]]:
        """Word ranges of text, a window long or more, that agree with a passage of a document before doc."""
        if not self.any:
            return []
        words = text.split(" ")
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        cover = bytearray(len(words))
        for end, (length, places) in self.trie.iter(f" {text} "):
            at = int(np.searchsorted(starts, end - length + 1))
            for k, off in places:
                source, passage = self.passages[k]
                first, last = max(0, at - off), min(len(words), at - off + len(passage))
                if source >= doc or last - first < self.window or cover.find(0, first, last) < 0:  # nothing that isn't found already
                    continue
                lo = hi = at
                while lo > first and words[lo - 1] == passage[lo - 1 - at + off]:
                    lo -= 1
                while hi < last and words[hi] == passage[hi - at + off]:
                    hi += 1
                if hi - lo >= self.window:
                    cover[lo:hi] = b"\1" * (hi - lo)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(cover, np.uint8), [0]]).astype(np.int8)))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _found(passages: DataFrame, visits: DataFrame, window: int) -> DataFrame:
    """(doc_id, fp, lo, hi): words to remove. Both sides are dealt by shard and copy."""
    schema = StructType([visits.schema["doc_id"], visits.schema["fp"], *fields(lo="int", hi="int")])

    def run(key, known, seen):
        rows = []
        if len(known) and len(seen):
            automaton = Automaton(list(zip(known["doc_id"].tolist(), known["words"], strict=True)), window)
            for doc, fp, start, text in zip(seen["doc_id"].tolist(), seen["fp"].tolist(), seen["start"].tolist(), seen["words"], strict=True):
                rows += ((doc, fp, start + lo, start + hi) for lo, hi in automaton.agreements(doc, text))
        return pd.DataFrame(rows, columns=schema.names)

    return passages.groupBy("shard", "copy").cogroup(visits.groupBy("shard", "copy")).applyInPandas(run, schema)


def repeated_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, and removed (merged word ranges): without words repeated from earlier documents."""
    docs = only(docs, "doc_id", "text").withColumn("fp", F.xxhash64("text")).withColumn("code", F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(bytearray())))
    marks = stash(_anchors(docs, window), "anchors")
    # what many rows are joined to is a table of its own each time, so that the join can be split at a common key
    known = stash(marks.groupBy("h").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("h"), "recurring")
    firsts = stash(docs.where("doc_id is not null").groupBy("fp", "code").agg(F.min("doc_id").alias("first")), "firsts")
    near = marks.join(known, "h").select("doc_id", "fp", "lo", "hi").join(firsts.select("fp", F.col("first").alias("doc_id")), ["doc_id", "fp"], "left_semi")
    prepared = stash(_prepared(docs, near, window), "prepared")
    pieces = prepared.where("stretches is not null").select("doc_id", "fp", F.explode("stretches").alias("p")).select("doc_id", "fp", "p.start", "p.words")
    # a number that two stretches share makes both be looked at, no more: whatever is found in them is compared word by word
    pieces = stash(pieces.dropDuplicates(["doc_id", "fp", "start"]).withColumn("piece", F.xxhash64("doc_id", "fp", "start")), "pieces")

    windows = _windows(pieces, window)
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    first = stash(first, "confirmed")
    shared = stash(windows.join(first, ["w1", "w2"]).select("doc_id", "piece", "s", "first"), "shared")

    passages = stash(_passages(pieces, shared.where("doc_id = first").select("piece", "s"), window), "passages")
    size = passages.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    shard = lambda x: F.pmod(F.xxhash64(x), F.lit(shards)).alias("shard")
    routes = shared.where("doc_id > first").select("piece", shard("first")).distinct()
    copies = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies"))
    visits = pieces.join(routes.join(copies, "shard"), "piece").withColumn("copy", F.pmod(F.xxhash64("piece"), F.col("copies")).cast("int"))
    known = passages.select("doc_id", "words", shard("doc_id")).join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "doc_id", "words")
    found = _found(known, visits.select("shard", "copy", "doc_id", "fp", "start", "words"), window)
    ranges = found.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    return _without(prepared, ranges, firsts, window)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _without(prepared: DataFrame, ranges: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = StructType([prepared.schema["doc_id"], *fields(n_words="long", n_removed="long", kept_sha256="string", removed=ArrayType(StructType(fields(start="long", stop="long"))))])

    def run(batches):
        for b in batches:
            removed, digest, spans = [], [], []
            for whole, text, found in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                gone = merged([(x["lo"], x["hi"]) for x in found or ()])
                if gone:
                    words, at, keep = words_of(text), 0, []
                    for lo, hi in gone:
                        keep += words[at:lo]
                        at = hi
                    whole = hashlib.sha256(b" ".join(keep + words[at:])).hexdigest()
                removed.append(sum(hi - lo for lo, hi in gone))
                digest.append(whole)
                spans.append([{"start": lo, "stop": hi} for lo, hi in gone])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, span)], names=schema.names)

    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    kept = prepared.where("stretches is null").select("doc_id", "fp", "code", "n_words", "whole").join(firsts, ["fp", "code"], "left")
    kept = kept.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(copy, all_).otherwise(F.array().cast(schema["removed"].dataType)).alias("removed"),
    )
    near = prepared.where("stretches is not null").join(ranges, ["doc_id", "fp"], "left").select("doc_id", "n_words", "whole", "text", "ranges")
    return near.mapInArrow(run, schema).unionByName(kept)
