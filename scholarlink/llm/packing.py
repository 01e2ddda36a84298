"""Best-fit packing of documents into sequences of a fixed number of tokens.

Every text becomes token ids and an end id; only documents longer than a sequence are cut, into full pieces after a first one
that may be shorter. Pieces then fall at random into groups of about GROUP and every group is packed by best-fit
decreasing: a segment tree over remaining capacities finds the tightest open sequence in logarithmic time for each piece.
A group leaves at most a few sequences part-filled, so groups cost next to nothing against packing all pieces at once.

Nulls, empties, repeats: a null text counts as empty, and an empty one is its end id alone. Repeated rows are packed as
often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import fields, only, stash

CAPACITY = 2048
END = 0
GROUP = 200_000
#: Entries of a task's cache of encoded words; emptied when full.
CACHE = 400_000
#: Fixed values of the byte-level BPE: what its pre-tokenizer takes for a piece, and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<|endoftext|>",)
PIECES = fields(piece="int", start="long", length="long", ids_crc32="long")


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next of those from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in prints else chr(next(rest)) for b in range(256))


class Encoder:
    """Token ids of whole texts, little-endian 32-bit, through a cache of words.

    The vocabulary is read from a tokenizers file of a byte-level BPE whose ids follow the order of its merges; the ids are
    those that the tokenizers library gives, made by tiktoken, which takes a quarter of its time for single words.

    Byte-level pre-tokenizers take a single blank before a word together with it and cut there, so a text may be cut before
    each such blank and its words encoded one by one. Where blanks adjoin other white space the whole text is encoded.

    encode() takes all of a text for letters. ids() also knows the file's added tokens, as the library does at its default
    settings: texts that hold one are left to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.path, self.library = path, None
        self.added = [t["content"] for t in file["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, piece)): k for piece, k in vocabulary.items() if all(c in byte_of for c in piece) and piece not in SPECIAL}
        self.encode_one = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes | None] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.encode_one(t)).tobytes() for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        firsts = self._encode([c[0] for c in cut])
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({w for c in cut for w in c[1:]}.difference(self.cache))
        whole = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        self.cache |= dict.fromkeys(whole)
        new = [w for w in new if w not in whole]
        self.cache |= zip(new, self._encode([" " + w for w in new]), strict=True)
        out = []
        for text, first, words in zip(texts, firsts, cut, strict=True):
            parts = [first, *map(self.cache.__getitem__, words[1:])]
            if None in parts or words[0][-1:].isspace():
                parts = self._encode([text])
            out.append(b"".join(parts))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        held = [any(a in t for a in self.added) for t in texts]
        out = self.encode(["" if h else t for t, h in zip(texts, held, strict=True)])
        if any(held):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            for k, h in enumerate(held):
                if h:
                    out[k] = array("I", self.library.encode(texts[k], add_special_tokens=False).ids).tobytes()
        return out


def cut(ids: bytes, capacity: int = CAPACITY):
    """(piece, start, length, crc32) of one document's ids; all pieces but the first are full."""
    n = len(ids) // 4
    stop = (n - 1) % capacity + 1
    start, piece = 0, 0
    while start < n:
        yield piece, start, stop - start, zlib.crc32(ids[start * 4 : stop * 4])
        start, stop, piece = stop, stop + capacity, piece + 1


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(key, text) -> key, piece, start, length, ids_crc32: a row for each piece."""
    schema = StructType([StructField(key, docs.schema[key].dataType), *PIECES])
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, rows = [], []
                for k, ids in enumerate(encoder.ids(texts)):
                    for row in cut(ids + end, capacity):
                        owner.append(k)
                        rows.append(row)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=schema.names)

    return only(docs, key, "text").mapInArrow(run, schema)


class OpenBins:
    """Open sequences by remaining capacity, with a segment tree that finds the tightest one that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, number: int) -> None:
        self.at[remaining].append(number)
        k = remaining + self.size
        while k and not self.tree[k]:
            self.tree[k] = True
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the tightest open sequence with at least `need` left, or None."""
        tree, k = self.tree, need + self.size
        while not tree[k]:  # up to where a right neighbour has one
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
            while not k & 1 and not tree[k]:
                k >>= 1
            if k <= 1:
                return None
        while k < self.size:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        remaining = k - self.size
        number = self.at[remaining].pop()
        if not self.at[remaining]:
            tree[k] = False
            while k > 1 and not tree[k ^ 1]:
                k >>= 1
                tree[k] = False
        return remaining, number


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins, made = OpenBins(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = bins.take(need)
        if found is None:
            found = capacity, made
            made += 1
        sequence[k], offset[k] = found[1], capacity - found[0]
        if found[0] > need:
            bins.put(found[0] - need, found[1])
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, key: str = "doc_id") -> DataFrame:
    """(key, text) -> key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stash(tokenize(docs, tokenizer, capacity, key), "pieces")
    groups = max(1, -(-pieces.count() // group))
    schema = StructType([*pieces.schema.fields, *fields(sequence_id="long", offset="long")])

    def run(g, rows):
        rows = rows.drop(columns="_g").reset_index(drop=True)
        sequence, rows["offset"] = best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(g[0]) << 32) + sequence
        return rows[schema.names]

    return pieces.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("_g").applyInPandas(run, schema)
