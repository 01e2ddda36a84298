"""Alias groups as components, containment by the rarest piece, likeness joins: against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scholarlink.operators import matching
from scholarlink.operators.aliases import alias_table, canonical
from scholarlink.operators.components import components


def reach(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    out = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = min(seen)
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [("a", "a"), (None, "b"), ("c", None)],
        [(f"n{k:03}", f"n{k + 1:03}") for k in range(90)],  # a chain
        [(f"n{random.Random(k).randint(0, 60):03}", f"n{random.Random(-k - 1).randint(0, 60):03}") for k in range(40)] * 2,
        [("hub", f"n{k}") for k in range(200)] + [("n3", "z"), ("z", "y")],
    ],
)
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert {r.node: r.component for r in got} == reach(edges) and len(got) == len(reach(edges))


def test_chained_groups_are_one_in_any_order(spark):
    rows = [(k, n) for k in range(5) for n in (f"Alder House {'x' * k}", f"Alder House {'x' * (k + 1)}")] + [(9, "Seoul National University"), (9, "Birch Works"), (10, "Birch Works"), (10, "A Birch Works of Great Length Indeed"), (11, "Lone Lodge"), (12, ""), (12, None)]
    want = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        aliases = alias_table(spark.createDataFrame(rows, "group_id long, name string"))
        names = spark.createDataFrame([(n,) for n in ("Alder House ", "ALDER HOUSE xxx", "Birch Works", "SNU", "서울대학교", "Lone Lodge", "Unheard Of", "KAIST")], "n string")
        got = {r.n: r.canonical for r in canonical(names, "n", aliases).collect()}
        assert got["Alder House "] == got["ALDER HOUSE xxx"] == "alderhousexxxxx"  # the longest key
        assert got["Birch Works"] == got["SNU"] == got["서울대학교"] != "abirchworksofgreatlengthindeed"  # a known group keeps its key
        assert got["Lone Lodge"] == "lonelodge" and got["Unheard Of"] == "unheardof" and got["KAIST"] != "kaist"
        assert want in (None, got)
        want = got


def test_contained_keys_lose_none(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choices("ab", k=rng.randint(1, 16))) for _ in range(400)} | {"".join(rng.choices("abcdefgh", k=rng.randint(3, 30))) for _ in range(300)})
    left, right = spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([(k,) for k in keys], "m string")
    got = {(r.k, r.m) for r in matching.contained_keys(left, right, "k", "m").where(F.col("m").contains(F.col("k"))).collect()}
    assert got == {(k, m) for k in keys for m in keys if len(k) >= 4 and k in m}


def test_common_pieces_bring_few_together(spark):
    """A third of the names share a long piece; what is brought together stays near what belongs together."""
    n = 100_000
    word = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 9)
    shared = F.when(F.col("id") % 6 == 0, "universityof").when(F.col("id") % 6 == 1, "instituteof").otherwise("")
    keys = spark.range(n).select(F.concat(shared, word(F.col("id")), F.when(F.col("id") % 10 == 0, word(F.floor(F.col("id") / 10))).otherwise("")).alias("k"))
    met = matching.contained_keys(keys, keys.withColumnRenamed("k", "m"), "k", "m").agg(F.count(F.lit(1)), F.count_if(F.col("m").contains(F.col("k")))).first()
    assert met[1] >= n and met[0] <= 3 * met[1]
