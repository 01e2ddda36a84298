"""Fill-in-middle, filter interaction audit and exact top-k search against plain Python on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlink.llm import infill, interaction, secrets, topk
from scholarlink.llm.common import stash

EXTRA = {"n": "long", "form": "string", "output": "string", "part": "string", "A": "boolean", "h": "long", "tokens": "string", "weight": "long", "score": "double", "shard": "int", "query_id": "long", "region": "int"}


def with_extra(df):
    return df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in EXTRA.items() if c not in df.columns])


def texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcÄß漢😀", k=rng.randint(1, 5)))
    gap = lambda: "".join(rng.choices(" \t\n\v\f\r", k=rng.randint(1, 3)))
    out = ["".join(word() + gap() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    out += [gap() + t for t in out[:10]]
    odd = [None, "", " ", "\n\n", "one", "no break blank x", "nul\x00 byte", "a <P> b c d", "<M>", "x<S", "y <P y> S>", "<<S <S", "\x1c unit \x85 y"]
    return out + odd + odd + ["long " * 30_000 + "end"]


def cut_up(doc_id, text):
    """What the contract says, one document at a time."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("part", [1, 1000, infill.PART])
def test_fill_in_middle_equals_one_document_at_a_time(spark, part):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a b c d"), (None, None), (7, "a b"), (7, "a b"), (-3, "x y z")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    out = infill.fill_in_middle(docs, part=part)
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(cut_up(*r) for r in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in out}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_with_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(k, f"t{k} a b  c\n") for k in range(300)], "doc_id long, text string")
    marks = ("[PRE]", "[SUF]", "[MID]")
    out = infill.fill_in_middle(docs, seed=7, percent=100, spm_percent=0, marks=marks)
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), marks))
    assert {r.form for r in out.collect()} == {"psm"}
    assert {(r.doc_id, r.back) for r in out.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    assert {r.form for r in infill.fill_in_middle(docs, percent=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=bad)


def audited(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    flags = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        flags.append((s or "", f, i in good, i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for part in {s or "" for _, _, s in rows}:
            left = [f for f in flags if f[0] == part]
            own = left
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                before = len([f for f in own if f[1][x]]) - len(gone)
                left = [f for f in left if not f[1][x]]
                alone = len([f for f in own if f[1][x] and sum(f[1].values()) == 1])
                out[part, "".join(order), step, x] = [len(left), len(gone), before, alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
    total = Counter()
    for (part, _, _, x), v in out.items():
        total[part, x] += v[1]
    return {k: (*v, total[k[0], k[3]]) for k, v in out.items()}


def test_audit_equals_a_replay_by_hand(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    bodies = [" ".join(word() for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(25)]
    bodies += [("ab cd " * 150).strip(), "AB " * 210, "A" + "x" * 49, "A" + "x" * 48, "50% off", " ", "", None, "tab\tand\vbreak\x1cunit"]
    rows = [(k, rng.choice(bodies), rng.choice(["s1", "s2", None, "", "s3"])) for k in range(120)]
    rows += [(None, bodies[0], "s1"), (None, None, None), (5, rows[5][1], "s1"), rows[9], rows[9]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (999, 1, 1)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(4)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")).withColumn("source", F.lit(1))
    want = audited(rows, labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    read = lambda df: {(r.part, r.filter_order, r.step, r.filter): tuple(r[c] for c in names) for r in df.collect()}
    out = interaction.audit(docs, rated)
    assert out.count() == len(want) and read(out) == want
    each = interaction.document_flags(docs, rated).withColumn("weight", F.lit(1).cast("long"))
    assert read(interaction.replay(each)) == want  # documents one by one give the same as documents combined
    assert interaction.audit(docs.limit(0), rated).count() == 0
    nobody = interaction.audit(docs, rated.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(nobody) == (0, 0)


def test_replay_of_other_filters(spark):
    flags = spark.createDataFrame([("p", True, False, True, True, 3), ("p", False, True, False, True, 2)], "part string, good boolean, toxic boolean, x boolean, y boolean, weight long")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interaction.replay(flags, "xy").collect()}
    assert out == {("xy", 1): (2, 3, 0, 0, 3), ("xy", 2): (0, 2, 3, 2, 7), ("yx", 1): (0, 5, 0, 2, 7), ("yx", 2): (0, 0, 3, 0, 3)}
    for bad in ("", "xx", "abcdefgh"):
        with pytest.raises(ValueError):
            interaction.replay(flags, bad)


def nearest(rows, k, scale=1024, every=100):
    kept = {}
    width = max((len(v) for _, v in rows if v is not None), default=0)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, list(v)), list(v))
    exact = lambda x: int(np.floor(x * scale)) if abs(x) < 1e15 else int(x) * scale
    whole = {i: [exact(float(x)) for x in v] + [0] * (width - len(v)) for i, v in kept.items()}
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = {}
    for q in whole:
        if q % every == 0:
            scored = sorted(((-limit(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q))
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def found(spark, data, k=10, every=100, **options):
    vectors = topk.usable(with_extra(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(vectors, queries, k, **options).collect()}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 8)), rng.normal(size=(500, 8)), np.tile(centres[0], (900, 1)), np.zeros((100, 8)), rng.integers(-1, 2, (400, 8)) / 1024])
    rows = [(k, v) for k, v in enumerate(x[rng.permutation(len(x))].tolist())]
    rows += [rows[3], rows[100], (200, [9.0] * 8), (None, [1.0] * 8), (5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] + [1.0] * 7), (5300, [float("inf")] * 8), (5400, [0.5, -0.25]), (5500, [])]
    want = nearest(rows, 10)
    assert found(spark, rows, block=20) == want  # one vector is held by a quarter of all rows; queries in several blocks
    assert found(spark, rows, rows=150, leaf=8) == want
    assert found(spark, rows, rows=150, leaf=8, regions=3, sample=50) == want
    assert found(spark, rows[:6], k=10, every=1) == nearest(rows[:6], 10, every=1)  # fewer than k
    assert found(spark, rows[:1], every=1) == {} and found(spark, []) == {}


def test_top_k_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate((rng.normal(size=(60, 3)) * 10.0 ** rng.integers(0, 9, (60, 1))).tolist())] + [(60, [1e300, 1.0, -1e308]), (61, [1e17, 3.0, 5.0]), (62, [-1e300, 0.0, 1e308])]
    assert found(spark, rows, every=10, leaf=4) == nearest(rows, 10, every=10)


def test_boxes_cut_off_what_cannot_be_near():
    rng = np.random.default_rng(4)
    centres = 100 * rng.normal(size=(40, 6))
    x = np.floor(centres[np.arange(8000) % 40] + rng.normal(size=(8000, 6)))
    ids = rng.permutation(8000).astype(np.int64)
    tree = topk.KDTree(ids, x, 64)
    queries, own = tree.x[:50], tree.ids[:50]
    best = [topk.Best(10, None, None) for _ in queries]
    measured = topk.traverse(tree, queries, own, best)
    for q, o, b in zip(queries, own, best, strict=True):
        order = np.lexsort((ids, -(x @ q)))
        want = [int(ids[r]) for r in order if ids[r] != o][:10]
        assert b.ids.tolist() == want
    assert measured < 0.2 * 50 * 8000
    limits = [topk.Best(10, b.score, b.last + 1) for b in best]  # the kth of a shard elsewhere leaves next to nothing to do
    assert topk.traverse(tree, queries, own, limits) <= measured
    for start, stop in tree.spans:
        k = tree.spans.index((start, stop))
        assert (tree.low[k] == tree.x[start:stop].min(axis=0)).all() and tree.least[k] == tree.ids[start:stop].min()


@pytest.fixture(scope="module")
def findings(spark):
    rng = random.Random(12)
    syllable = ["ka", "ren", "to", "mil", "os", "ta", "ver", "lin", "du", "pe", "sor", "an"]
    words = ["".join(rng.choices(syllable, k=rng.randint(1, 4))) for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(30, 120)))) for k in range(700)] + [(None, "a b"), (701, None), (702, "")], "doc_id long, text string").cache()
    dictionary = stash(secrets.dictionary(docs), "words")
    return docs, stash(secrets.labelled(docs, dictionary, sample=700), "labelled")


def test_planted_findings_are_where_they_were_put(spark, findings):
    docs, known = findings
    rows = secrets.planted(docs, sample=700).collect()
    assert len(rows) > 3000 and all(r.text[r.at : r.at + len(r.value)] == r.value for r in rows)
    assert {r.kind for r in rows} == set(range(secrets.SECRETS + secrets.DECOYS)) and all(r.is_secret == (r.kind < secrets.SECRETS) for r in rows)
    kinds = {r.kind: r.n for r in known.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) >= set(range(secrets.SECRETS)) and secrets.planted(docs.limit(0)).count() == 0
    # no single feature decides: a hash is a secret after one name and none after another, a name stands before placeholders too
    both = known.groupBy(F.col("key") > 0).agg(F.count_distinct("is_secret").alias("n")).collect()
    assert [r.n for r in both] == [2, 2]


def test_forest_on_findings_held_out(findings):
    _, known = findings
    held = secrets.held_out(F.col("source_id"))

    def measured(train, test):
        hit = F.col("score") >= 0.5
        r = secrets.score(test, secrets.train(train)).agg(F.count_if(F.col("is_secret") & hit).alias("tp"), F.count_if(~F.col("is_secret") & hit).alias("fp"), F.count_if(F.col("is_secret") & ~hit).alias("fn")).first()
        return r.tp / max(1, r.tp + r.fp), r.tp / max(1, r.tp + r.fn)

    precision, recall = measured(known.where(~held), known.where(held))
    assert precision >= 0.95 and recall >= 0.9
    kinds = F.col("kind").isin(1, 5, 9, 12)  # kinds of secrets and decoys that the forest never saw
    precision, recall = measured(known.where(~held & ~kinds), known.where(held & kinds))
    assert precision >= 0.6 and recall >= 0.8


def test_training_sample_is_bounded_and_has_both_kinds(findings):
    _, known = findings
    same = known.where("is_secret").limit(1).drop("doc_id").crossJoin(known.sparkSession.range(20_000).withColumnRenamed("id", "doc_id"))
    rare = same.unionByName(known.where("not is_secret").select(*same.columns).limit(5))
    model = secrets.train(rare, sample=1000)
    forest = model.stages[-1]
    assert forest.numClasses == 2 and forest.getNumTrees == 40
    scored = {r.is_secret: r.m for r in secrets.score(rare, model).groupBy("is_secret").agg(F.avg("score").alias("m")).collect()}
    assert scored[True] > 0.9 > 0.5 > scored[False]
    assert secrets.train(same, sample=10) == 1.0 and secrets.train(known.where("not is_secret")) == 0.0 and secrets.train(known.limit(0)) == 0.0
