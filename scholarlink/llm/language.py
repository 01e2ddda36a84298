"""Language of the words of code-switched text: a linear-chain conditional random field.

Each word has hashed features: its byte n-grams of one to four bytes between boundary marks, so that those at the marks are
its affixes, and the whole word, the lexicon feature. The field adds up the features' weights by language and learned
transition weights between neighbouring words; forward-backward gives each word's probability of each language. A
document's language is the one with the largest mean probability over its words, that mean is the score.

Training takes a bounded sample: about `per_language` labelled documents of each language, each different text of a doc_id
once, picked by a hash; texts over LONGEST bytes teach nothing. They are cut into pieces and spliced at random, so that
transitions between languages are seen, and the likelihood is maximised by Adam, with the gradient of forward-backward's
marginals: of words for the features, of neighbouring words for the transitions.

Nulls, empties, repeats: a text that is null or has no letter is `und` with score 0; where nothing was learned all are.
Rows with null lang or doc_id teach nothing. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import fields, mix, only

BITS = 18
#: Languages learned at most, the most frequent ones; so many rows are broadcast to pick the sample.
LANGUAGES = 1_000
#: Bytes of a text of the sample at most.
LONGEST = 1_000_000
#: Words of which a task keeps the scores; emptied when full. Words scored at once.
CACHE, CHUNK = 300_000, 1_500_000


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of each word, one after the other, and where each word's begin (for reduceat); -1 is no feature."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(words))
    raw = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint64)
    n = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    out, h, at = np.full((n, 5), -1, np.int64), np.zeros(n, np.uint64), np.arange(n)
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            h = h * np.uint64(1_000_003) + raw[k - 1 : k - 1 + n] + np.uint64(1)
            inside = at + k <= ends
            out[inside, k - 1] = (mix(h[inside] + np.uint64(k << 50)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out[starts, 4] = (mix(whole + np.uint64(9 << 50)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return out.ravel(), starts * 5


def emissions(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features; weights has a row of zeros at its end for `no feature`."""
    out = [np.zeros((0, weights.shape[1]), np.float32)]
    for k in range(0, len(words), 20_000):
        ids, starts = features(words[k : k + 20_000])
        out.append(np.add.reduceat(weights[ids], starts, axis=0))
    return np.concatenate(out)


def forward_backward(e: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of each word. e: scores of all words, document after document; all documents take a step together.

    pairs, if given, gets the sum of the joint marginals of all neighbouring words: expected transitions.
    """
    p = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(transitions).astype(np.float32)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right") if len(lengths) else []
    alpha, state = np.empty_like(p), None
    for t, n in enumerate(alive):
        at = starts[:n] + t
        state = p[at] if state is None else (state[:n] @ a) * p[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    beta = np.ones((len(lengths), p.shape[1]), np.float32)
    out, inward = np.empty_like(p), a.T.copy()
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at, b = starts[:n] + t, beta[:n]
        m = alpha[at] * b
        out[at] = m / m.sum(axis=1, keepdims=True)
        onward = p[at] * b
        b = onward @ inward
        if pairs is not None and t:
            before = alpha[at - 1]
            pairs += a * ((before / (before * b).sum(axis=1, keepdims=True)).T @ onward)
        beta[:n] = b / b.sum(axis=1, keepdims=True)
    return out


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def fit(samples: list[tuple[str, str]], rounds: int = 3, length: int = 64, batch: int = 128, seed: int = 7) -> Model:
    """A model from (language, text) samples."""
    languages = sorted({x for x, _ in samples})
    rng = np.random.default_rng(seed)
    weights, transitions = np.zeros(((1 << BITS) + 1, len(languages)), np.float32), np.zeros((len(languages),) * 2, np.float32)
    pieces = []
    for language, text in samples:
        w, at = words_of(text), 0
        while at < len(w):
            n = int(rng.integers(4, 3 * length))
            pieces.append((languages.index(language), w[at : at + n]))
            at += n
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    step = 0
    for _ in range(rounds if len(languages) > 1 else 0):
        order = rng.permutation(len(pieces))
        gold = np.concatenate([np.full(len(pieces[k][1]), pieces[k][0]) for k in order])
        words = [x for k in order for x in pieces[k][1]]
        for at in range(0, len(words), length * batch):
            w, y = words[at : at + length * batch], gold[at : at + length * batch]
            lengths = np.append(np.full(len(w) // length, length), len(w) % length)
            lengths = lengths[lengths > 0]
            ids, starts = features(w)
            expected = np.zeros_like(transitions)
            marginal = forward_backward(np.add.reduceat(weights[ids], starts, axis=0), lengths, transitions, expected)
            slope = marginal.copy()
            slope[np.arange(len(w)), y] -= 1
            each = np.repeat(slope, np.diff(np.append(starts, len(ids))), axis=0)
            grad = np.stack([np.bincount(ids[ids >= 0], each[ids >= 0, k], minlength=len(weights)) for k in range(len(languages))], axis=1)
            inside = np.ones(len(w), bool)
            inside[np.cumsum(lengths) - 1] = False
            k = np.flatnonzero(inside)
            seen = np.zeros_like(transitions)
            np.add.at(seen, (y[k], y[k + 1]), 1)
            step += 1
            for x, g, m, v, rate in ((weights, grad / len(w), *moments[:2], 0.02), (transitions, (expected - seen) / len(w) + 1e-3 * transitions, *moments[2:], 0.05)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            weights[-1] = 0
    return Model(languages, weights, transitions)


def learn(docs: DataFrame, usable: Column, per_language: int = 120) -> Model:
    """Fit on about per_language of the rows of each lang (all, where there are fewer) for which `usable` holds."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30)) / (1 << 30)
    near = labelled.join(F.broadcast(counts), "lang").where((share * F.col("count") < per_language) & (F.octet_length("text") <= LONGEST))
    sample = near.select("lang", "text", "doc_id").distinct()
    return fit([(r.lang, r.text) for r in sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))])


def label(docs: DataFrame, model: Model, segments: bool = False) -> DataFrame:
    """docs with lang_pred and score; with segments also the runs of words of one language (struct lang, n_words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows by languages, whatever the corpus
    run = StructType(fields(lang="string", n_words="long"))
    added = fields(lang_pred="string", score="double") + (fields(segments=ArrayType(run)) if segments else [])
    base = [n for n in docs.columns if n not in ("lang_pred", "score", "segments")]
    schema = StructType([docs.schema[n] for n in base] + added)

    def predict(batches):
        m = shared.value
        known: dict[bytes, int] = {}
        table = np.zeros((0, len(m.languages)), np.float32)
        for batch in batches:
            column = batch.column(base.index("text"))
            sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in _chunks(sizes, CHUNK * 5):
                texts = column.slice(lo, hi - lo).to_pylist()
                split = [words_of(t) if t is not None and any(map(str.isalpha, t)) and m.languages else [] for t in texts]
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                if len(known) > CACHE:
                    known, table = {}, table[:0]
                new = list({w for ws in split for w in ws}.difference(known))
                known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
                table = np.concatenate([table, emissions(new, m.weights)])
                which = np.fromiter((known[w] for ws in split for w in ws), np.int64, int(lengths.sum()))
                full = np.flatnonzero(lengths)
                pred, score, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                if len(full):
                    marginal = forward_backward(table[which], lengths[full], m.transitions)
                    starts = np.cumsum(lengths[full]) - lengths[full]
                    mean = np.add.reduceat(marginal, starts, axis=0, dtype=np.float64) / lengths[full][:, None]
                    for k, best, p in zip(full, mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0), strict=True):
                        pred[k], score[k] = m.languages[best], p
                    if segments:
                        best = marginal.argmax(axis=1)
                        for k, s in zip(full, starts, strict=True):
                            own = best[s : s + lengths[k]]
                            edge = np.flatnonzero(np.diff(np.concatenate([[-1], own, [-1]])))
                            runs[k] = [{"lang": m.languages[own[a]], "n_words": int(b - a)} for a, b in zip(edge[:-1], edge[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                more = [pa.array(pred, pa.string()), pa.array(score, pa.float64())] + ([pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64())])))] if segments else [])
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(base))] + more, names=schema.names)

    return docs.select(*base).mapInArrow(predict, schema)


def _chunks(sizes: np.ndarray, limit: int):
    """Ranges of rows of about `limit` in all, one row at least."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = 120, segments: bool = False) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from its rows that aren't held out."""
    return label(docs, learn(only(docs, "doc_id", "text", "lang"), ~held_out(), per_language), segments).withColumn("held_out", held_out())
