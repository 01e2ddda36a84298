"""Near duplicates: a self-join of n-gram sets by Jaccard similarity with prefix filtering, and the components it links.

N-grams are ordered rare first: those that counting finds frequent go last, by their counts, the others by hash. Two sets of
similarity t or more share an n-gram among the first n - ceil(t n) + 1 of either, so only those prefixes meet. Equal sets are
one class from the start, by a 128-bit hash. Of a class's n-grams where just the same classes meet, the first stands for all.
Where classes meet at an n-gram, these filters go inside the join, before a pair is made:
  length      the smaller set has at least t times the larger one's size;
  positional  what precedes and what follows the places of the common n-gram can still make up the overlap needed (in the last
              round what follows alone, since a pair is made at the first n-gram that it has in common);
  suffix      the sets' parities in 512 cells of the hash range differ in no more cells than the sets may differ in n-grams;
and then, for the pairs made,
  prefix      the common n-grams of the two prefixes, all that there are up to the nearer prefix's end, leave enough to come.
What is left is verified once per pair, on the whole sets.

Only components are wanted, so pairs within one component need no look. The first round compares every class with one of
its n-gram's group, the class with the smallest share of n-grams of its own; the next one, if the pairs between components
outnumber the rows CROWDED times, with the members that have most links so far. A last round takes all
pairs that are still in different components, none excepted, so that no link between different texts is lost; groups of more
than BLOCK classes are compared block by block.

Nulls, empties, repeats: a text that is null or without words has an empty set and links with nothing; with fewer words than
n, the whole sequence is its one n-gram. Repeated rows are copies like others. A null doc_id is passed over by the smallest
doc_id of a component unless it has no other. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fields, gram_hashes, only, stash, word_hashes

#: Frequent n-grams: so many of them at most are broadcast, the most frequent ones, each found in LEAST documents or more.
#: A task counts CHUNK n-grams at a time and passes on those that it saw twice; the order decides cost only, never results.
FREQUENT, LEAST, CHUNK = 1 << 18, 16, 4_000_000
#: Longs of a sketch: 64 parities each.
SKETCH = [f"s{k}" for k in range(8)]
#: Bits of the filter that picks the documents whose sets are fetched, and of each of its parts (what bitmap_construct_agg makes);
#: its size is fixed, and a false hit only costs time.
FILTER, PART = 1 << 23, 1 << 15
#: Groups of n-grams that may be larger than this are joined rather than windowed.
HOT = 50_000
#: Centres of a group in a later round, each the best linked of its share of the members.
CENTRES = 4
#: Pairs for each row above which a round of centres comes before the round of all pairs; one such round at most.
CROWDED = 300
#: Classes of a group that meet in one block of the last round.
BLOCK = 2_000


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words of a text, A-Z in lower case."""
    h = word_hashes(b"" if text is None else text.encode("utf-8", "surrogatepass").lower())
    g = np.sort(gram_hashes(h, min(n, len(h)))) if len(h) else h
    return g[np.concatenate([g[:1] == g[:1], g[1:] != g[:-1]])]


def signature(sets: np.ndarray) -> tuple[int, int]:
    """The class of a set: 128 bits, as two signed longs; zeros for the empty set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(sets.tobytes(), seed=len(sets)), "<i8").tolist()) if len(sets) else (0, 0)


def sketch(sets: np.ndarray) -> np.ndarray:
    """512 parities: of how many n-grams fall in each cell of the hash range."""
    odd = np.bincount((sets & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def needed(t: Column | float, a: Column, b: Column) -> Column:
    """The overlap at which two sets of these sizes reach t percent: 100 * o >= t * (a + b - o)."""
    return F.ceil(F.lit(t) * (a + b) / (100.0 + t) - 1e-9)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of all documents, sorted, and about how many documents have each."""

    def count(batches):
        held, size = np.empty(CHUNK, np.uint64), 0

        def flush():  # in place: a run of equal neighbours is an n-gram found again
            g = held[:size]
            g.sort()
            edge = np.flatnonzero(np.diff(g[1:] == g[:-1], prepend=False, append=False))
            return pa.RecordBatch.from_arrays([pa.array(_signed(g[edge[::2]])), pa.array(edge[1::2] - edge[::2] + 1)], names=["g", "k"])

        for b in batches:
            for text in b.column(0):
                g = grams(text.as_py(), n)
                while len(g):
                    part = g[: CHUNK - size]
                    held[size : size + len(part)] = part
                    size, g = size + len(part), g[len(part) :]
                    if size == CHUNK:
                        yield flush()
                        size = 0
        if size:
            yield flush()

    seen = only(docs, "text").mapInArrow(count, StructType(fields(g="long", k="long"))).groupBy("g").agg(F.sum("k").alias("k")).where(F.col("k") >= LEAST)
    seen = stash(seen.withColumn("rank", F.floor(F.log2("k") * 16).cast("int")), "frequent")
    total, lowest = 0, 0
    for r in sorted(seen.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):  # 16 ranks an octave
        total += r["count"]
        if total > FREQUENT:
            lowest = r["rank"] + 1
            break
    table = seen.where(F.col("rank") >= lowest).select("g", "k").toPandas()  # FREQUENT rows at most
    g, k = table["g"].to_numpy(np.int64).view(np.uint64), table["k"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], k[order]


def counted(g: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of n-grams: those of the frequent ones, 0 for the rest."""
    if not len(known):
        return np.zeros(len(g), np.int64)
    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return np.where(known[at] == g, counts[at], 0)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _prefixes(docs: DataFrame, n: int, percent: int, often, key: str) -> DataFrame:
    """(key, t, n, c1, c2, sketch, cold, prefix): hash of the text; size, class and sketch of its set; its first n-grams, those below `cold` not taken for hot."""
    schema = StructType([docs.schema[key], *fields(t="long", n="int", c1="long", c2="long", **dict.fromkeys(SKETCH, "long"), cold="int", prefix="longs")])

    def run(batches):
        known, counts = often.value
        for b in batches:
            ns, classes, sketches, cold, prefix = [], [], [], [], []
            for text in b.column(2):
                g = grams(text.as_py(), n)
                ns.append(len(g))
                classes.append(signature(g))
                sketches.append(sketch(g))
                f = counted(g, known, counts)
                first = np.argsort(f, kind="stable")[: prefix_length(len(g), percent) if len(g) else 0]  # equal counts stay by hash
                prefix.append(_signed(g[first]))
                cold.append(int((f[first] <= HOT).sum()))
            sketches = np.stack(sketches) if sketches else np.zeros((0, len(SKETCH)), np.int64)
            c = np.array(classes, np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int32()), pa.array(c[:, 0]), pa.array(c[:, 1]), *(pa.array(sketches[:, k]) for k in range(len(SKETCH))), pa.array(cold, pa.int32()), lists], names=schema.names)

    return docs.select(key, F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)


def _meetings(classes: DataFrame, percent: int) -> DataFrame:
    """(token, c, n, pos, own, weight, sketch): the n-grams of prefixes where different classes meet, one for all of a class where the same classes do.

    own is the share of a class's prefix, in thousandths of its n-grams, that meets no other; weight says for how many n-grams the row stands.
    """
    rows = classes.select("c", "n", "cold", F.posexplode("prefix").alias("pos", "token"))
    packed = rows.where("pos < cold").select("token", "c", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))  # two numbers in one, for a narrower shuffle
    k, x = F.count(F.lit(1)), F.bit_xor(F.xxhash64("c"))  # x tells apart who meets, among the n-grams of one class
    few = packed.select("*", k.over(W.partitionBy("token")).alias("k"), x.over(W.partitionBy("token")).alias("x")).where("k > 1")
    many = rows.where("pos >= cold").select("token", "c", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))
    met = few.unionByName(many.join(many.groupBy("token").agg(k.alias("k"), x.alias("x")).where("k > 1"), "token")).select("token", "c", "at", F.xxhash64("k", "x").alias("x"))
    same, own = W.partitionBy("c", "x"), W.partitionBy("c")
    n = F.shiftright("at", 32).cast("int")
    first = met.select("*", F.count(F.lit(1)).over(own).alias("met"), F.count(F.lit(1)).over(same).cast("int").alias("weight"), F.row_number().over(same.orderBy("at", "token")).alias("r")).where("r = 1")
    first = first.select("token", "c", n.alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "met", "weight")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    first = first.select("token", "c", "n", "pos", (1000 * (length - F.col("met")) / F.col("n")).cast("int").alias("own"), "weight")
    return first.join(classes.select("c", *SKETCH), "c")


def _fits(a, b, percent: int, first: bool = False) -> Column:
    """The length, positional and suffix filters for two members of a group; a and b give their columns by name. first: the group's n-gram has to be the first that they have in common."""
    na, nb, i, j = a("n"), b("n"), a("pos"), b("pos")
    need = needed(percent, na, nb)
    reach = (0 if first else F.least(i, j)) + 1 + F.least(na - i - 1, nb - j - 1)
    apart = reduce(Column.__add__, [F.bit_count(a(s).bitwiseXOR(b(s))) for s in SKETCH])
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (reach >= need) & (na + nb - apart >= 2 * need)


def _pair(a: Column, b: Column, n_a: Column, n_b: Column) -> list[Column]:
    """a < b and their sizes."""
    x, y = F.struct(a.alias("c"), n_a.alias("n")), F.struct(b.alias("c"), n_b.alias("n"))
    lo, hi = F.least(x, y), F.greatest(x, y)
    return [lo["c"].alias("a"), hi["c"].alias("b"), lo["n"].alias("n_a"), hi["n"].alias("n_b")]


def _starred(rows: DataFrame, centres: DataFrame, percent: int, more: Column | None = None) -> DataFrame:
    """(a, b, n_a, n_b) once: members of groups with the centres (token, m) of their groups, as far as the filters let them."""
    both = rows.join(centres, "token")
    fits = (F.col("c") != F.col("m.c")) & _fits(F.col, lambda k: F.col(f"m.{k}"), percent)
    return both.where(fits if more is None else more & fits).select(*_pair(F.col("c"), F.col("m.c"), F.col("n"), F.col("m.n"))).distinct()


def _lists(met: DataFrame) -> DataFrame:
    """(c, ones, more) once for each class: the n-grams where it meets others, those that stand for themselves apart from (token, weight) of the rest; a prefix has no more."""
    one = F.col("weight") == 1  # numbers are looked up when lists are compared, but each struct is held against all others
    return met.groupBy("c").agg(F.collect_list(F.when(one, F.col("token"))).alias("ones"), F.collect_list(F.when(~one, F.struct("token", "weight"))).alias("more"))


def _enough(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the prefix filter, by the lists of their classes: one row for each class, however many n-grams it has."""
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    lists = lists.join(wanted, "c", "left_semi")
    both = pairs.join(lists.toDF("a", "ones_a", "more_a"), "a").join(lists.toDF("b", "ones_b", "more_b"), "b")
    common = F.aggregate(F.array_intersect("more_a", "more_b"), F.size(F.array_intersect("ones_a", "ones_b")).cast("long"), lambda s, x: s + x["weight"])
    return _near_enough(both.withColumn("common", common), percent).select("a", "b", "n_a", "n_b")


def _near_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """The prefix filter for pairs whose prefixes have `common` n-grams in common."""
    na, nb = F.col("n_a"), F.col("n_b")
    after = lambda n: F.ceil(n * percent / 100.0 - 1e-9) - 1  # noqa: E731  n-grams behind a prefix
    return pairs.where(F.col("common") + F.greatest(after(na), after(nb)) >= needed(percent, na, nb))


def _all_pairs(rest: DataFrame, sizes: DataFrame, percent: int, lists: DataFrame | None = None) -> DataFrame:
    """(a, b, n_a, n_b) once: all members of a group with different labels, as far as the filters let them. sizes: (token, k); lists: those of rest, if made before.

    A pair is made where its first common n-gram is: nothing before it counts, so that n-gram is early enough in both sets, and
    within the first n - needed(n, n) + 1 of the smaller one. What pairs have in common is counted afterwards, on those few.
    """
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    rows = rest.join(sizes.select("token", blocks.alias("blocks")), "token").withColumn("block", F.pmod(F.xxhash64("c", F.lit(9)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    side = lambda df, x, y: df.select("token", F.explode(every).alias(f"block_{y}"), F.col("block").alias(f"block_{x}"), *[F.col(k).alias(f"{k}_{x}") for k in ("c", "n", "pos", "label", *SKETCH)])
    a, b = side(rows.where(F.col("pos") <= F.col("n") - needed(percent, F.col("n"), F.col("n"))), "a", "b"), side(rows, "b", "a")  # a is the smaller set
    of = lambda x: lambda k: F.col(f"{k}_{x}")
    fits = (F.col("label_a") != F.col("label_b")) & (F.struct("n_a", "c_a") < F.struct("n_b", "c_b")) & _fits(of("a"), of("b"), percent, first=True)
    met = a.join(b, ["token", "block_a", "block_b"]).where(fits)
    pairs = met.select(*_pair(F.col("c_a"), F.col("c_b"), F.col("n_a"), F.col("n_b"))).distinct()
    return _enough(stash(pairs, "meeting"), _lists(rest) if lists is None else lists, percent)  # n-grams of groups with one label are common to no such pair


def _filter(wanted: DataFrame) -> np.ndarray:
    """The filter's bytes for wanted (t). Tasks build and merge its parts; FILTER / PART rows of PART bits at most reach the driver."""
    k = F.pmod("t", F.lit(FILTER))
    parts = wanted.groupBy(F.floor(k / PART).alias("part")).agg(F.bitmap_construct_agg(F.pmod(k, F.lit(PART))).alias("bits"))
    out = np.zeros((FILTER // PART, PART // 8), np.uint8)
    for r in parts.collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, c1, c2, grams) of the classes in wanted (c, t, c1, c2), dealt by c1 and c2; only texts whose hash the filter has are cut into n-grams."""
    picked = docs.sparkSession.sparkContext.broadcast(_filter(wanted))
    schema = StructType(fields(c1="long", c2="long", grams="longs"))

    def run(batches):
        bits, done = picked.value, set()
        for b in batches:
            t = b.column(0).to_numpy() % FILTER
            out = []
            for k in np.flatnonzero(bits[t >> 3] >> (t & 7) & 1).tolist():
                g = grams(b.column(1)[k].as_py(), n)
                c = signature(g)
                if len(g) and c not in done:
                    if len(done) > 100_000:
                        done.clear()
                    done.add(c)
                    out.append((*c, _signed(g)))
            columns = zip(*out, strict=True) if out else ([],) * 3
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

    found = docs.select(F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)
    return found.dropDuplicates(["c1", "c2"]).join(wanted.select("c", "c1", "c2"), ["c1", "c2"]).select("c", "c1", "c2", "grams")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, percent: int, name: str) -> DataFrame | None:
    """The pairs that reach the similarity, as (a, b); None if there is no pair to verify."""
    pairs = stash(pairs.select("a", "b", needed(percent, F.col("n_a"), F.col("n_b")).cast("long").alias("need")), f"{name}-pairs")
    if pairs.isEmpty():
        return None
    wanted = stash(classes.select("c", "t", "c1", "c2").join(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "c", "left_semi"), f"{name}-wanted")
    sets = _sets(docs, wanted, n)  # both joins read one exchange of it, since the pairs come by the classes' hashes
    for x in "ab":
        pairs = pairs.join(wanted.select(F.col("c").alias(x), F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2")), x)
    side = lambda x: sets.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("grams").alias(f"grams_{x}"))
    found = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).where(F.size(F.array_intersect("grams_a", "grams_b")) >= F.col("need"))
    return stash(found.select("a", "b"), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the smallest node that each can reach."""
    edges = stash(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "to"), "edges")
    labels = stash(edges.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "labels")
    while True:
        told = edges.join(labels.select(F.col("node").alias("to"), F.col("label").alias("new")), "to").groupBy("node").agg(F.min("new").alias("new"))
        least = labels.join(told, "node").select("node", F.least("label", "new").alias("label"), F.col("label").alias("old"))
        least = stash(least, "least")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stash(least.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, key: str = "doc_id") -> DataFrame:
    """(key, text) -> key, n_shingles, component_id (the smallest key that links reach, the row's own included)."""
    spark = docs.sparkSession
    docs = only(docs, key, "text")
    often = spark.sparkContext.broadcast(frequent(docs, n))
    documents = stash(_prefixes(docs, n, percent, often, key), "prefixes")
    classes = documents.where("n > 0").drop(key).dropDuplicates(["c1", "c2"]).withColumn("c", F.monotonically_increasing_id())
    classes = stash(classes, "classes")  # so the numbers stay
    met = stash(_meetings(classes, percent), "met")
    lists = stash(_lists(met), "lists")  # for all rounds

    member = F.struct("c", "n", "pos", *SKETCH)
    links = spark.createDataFrame([], "a long, b long")
    first = stash(_starred(met, met.groupBy("token").agg(F.min(F.struct("own", "c", "n", "pos", *SKETCH)).alias("m")), percent), "first")
    found = _verified(docs, _enough(first, lists, percent), classes, n, percent, "own")
    links = links if found is None else found
    for turn in ("centres", "all"):
        label = stash(components(links), "components").withColumnRenamed("node", "c")
        degree = links.select(F.col("a").alias("c")).union(links.select("b")).groupBy("c").agg(F.count(F.lit(1)).alias("degree"))
        now = met.join(label.join(degree, "c"), "c", "left").withColumn("label", F.coalesce("label", "c")).fillna(0, ["degree"])
        open_ = now.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k")).where("x < y").select("token", "k")
        open_ = stash(open_, "open")
        size = open_.agg(F.sum(F.col("k") * F.col("k")).alias("pairs"), F.sum("k").alias("rows")).first()
        rest = stash(now.join(open_.select("token"), "token", "left_semi"), "rest")
        if turn == "centres" and (size.pairs or 0) > CROWDED * (size.rows or 0):
            share = F.pmod(F.xxhash64("c", F.lit(4)), F.lit(CENTRES))
            best = rest.groupBy("token", share.alias("share")).agg(F.max(F.struct("degree", F.col("label").alias("label"), member.alias("m"))).alias("best"))
            pairs = _enough(stash(_starred(rest, best.select("token", "best.m", F.col("best.label").alias("label_m")), percent, F.col("label") != F.col("label_m")), "more"), lists, percent)
        else:
            turn = "all"
            pairs = _all_pairs(rest, open_, percent, lists)
        found = _verified(docs, pairs, classes, n, percent, turn)
        links = links if found is None else links.unionByName(found)
        if turn == "all":
            break
    label = components(links).withColumnRenamed("node", "c")
    own = documents.where("n > 0").groupBy("c1", "c2").agg(F.min(key).alias("least"))
    linked = classes.select("c", "c1", "c2").join(label, "c").join(own, ["c1", "c2"])
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = own.join(linked.join(least, "label").select("c1", "c2", "component_id"), ["c1", "c2"], "left").select("c1", "c2", F.coalesce("component_id", "least").alias("component_id"))
    size = F.col("n").cast("long").alias("n_shingles")
    some = documents.where("n > 0").select(key, "n", "c1", "c2").join(whole, ["c1", "c2"]).select(key, size, "component_id")
    return some.unionByName(documents.where("n = 0").select(key, size, F.col(key).alias("component_id")))
