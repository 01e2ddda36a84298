"""Joins by likeness, each through keys that every true pair shares: names, organisations, domains. None is a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_keys, same_person, with_nfkc
from ..functions.orgs import accepted_domains, acronym, core_key, org_key, org_tokens, same_tokens, suffixes
from .aliases import Aliases, by_group
from .store import settle


def match_names(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) of the two name columns that can be one person's. Work on distinct names; join back after."""
    composed = lambda df, c, x: with_nfkc(df.select(c).where(F.col(c).isNotNull()).distinct(), c, x)
    keyed = lambda df, c, x: composed(df, c, x).select(c, x, F.explode(name_keys(F.col(x))).alias("key"))
    return keyed(left, a, "_x").join(keyed(right, b, "_y"), "key").select(a, b, "_x", "_y").distinct().where(same_person(F.col("_x"), F.col("_y"))).select(a, b)


#: Lengths of the pieces of a key; a key is looked for by pieces of the greatest length that it has.
PIECES = (4, 6, 8, 12)


def _pieces(key: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - length + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(length)))


def contained_keys(inner: DataFrame, outer: DataFrame, k: str, m: str) -> DataFrame:
    """Candidates (k, m) of keys k of four letters or more within keys m, by the rarest piece of each k: all true pairs and few others.

    An inverted index holds the pieces of the outer keys that any inner key has. A key with a piece that no outer key has is in none; any other meets only
    the outer keys that hold the piece that fewest of them hold. What it meets still has to be compared.
    """
    size = F.length(k)
    own_pieces = F.when(size >= PIECES[0], _pieces(F.col(k), PIECES[0]))
    for n in PIECES[1:]:
        own_pieces = F.when(size >= n, _pieces(F.col(k), n)).otherwise(own_pieces)
    own = inner.select(k).where(size >= PIECES[0]).distinct().select(k, F.explode(F.array_distinct(own_pieces)).alias("piece"))
    all_pieces = F.concat(*[F.when(F.length(m) >= n, _pieces(F.col(m), n)).otherwise(F.array().cast("array<string>")) for n in PIECES])
    index = outer.select(m).where(F.length(m) >= PIECES[0]).distinct().select(m, F.explode(F.array_distinct(all_pieces)).alias("piece"))
    index = index.join(own.select("piece").distinct(), "piece", "left_semi")
    held = settle(index.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))  # a table of its own, so that the join can be split at a common piece
    found = own.join(held, "piece", "left").groupBy(k).agg(F.count(F.lit(1)).alias("pieces"), F.count("n").alias("held"), F.min(F.struct("n", "piece")).alias("rarest"))
    rare = found.where("pieces = held").select(k, F.col("rarest.piece").alias("piece"))
    return rare.join(index, "piece").select(k, m)


def described(names: DataFrame, column: str, aliases: Aliases) -> DataFrame:
    """Distinct names with what organisations are compared by: key of the group, own key, acronym, content words."""
    own = with_nfkc(names.select(column).where(F.col(column).isNotNull()).distinct(), column, "_c")
    own = own.select(column, org_key(F.col("_c")).alias("own"), acronym(F.col("_c")).alias("acr"), org_tokens(F.col("_c")).alias("words"))
    return by_group(own, aliases).where("canonical != ''").select(column, "canonical", "own", "acr", "words")


def match_orgs(left: DataFrame, right: DataFrame, a: str, b: str, aliases: Aliases, strict: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of the two columns of organisation names that name one organisation.

    Strict: one alias group or key, or equal content words. Else also an acronym of three letters or more that is the other's
    key, a group key of four letters or more within the other's, or an own key within the other's own (what a group goes by hides
    none of its names), or content words equal to those of an alias. All rules of equal keys go by one join of the keys, each of its kind.
    """
    x, y = described(left, a, aliases).toDF(a, "k1", "o1", "r1", "w1"), described(right, b, aliases).toDF(b, "k2", "o2", "r2", "w2")
    if not strict:  # read by several joins below
        x, y = settle(x), settle(y)
    kind = lambda name, key: F.concat(F.lit(name), key)
    short = lambda r: F.when(F.length(r) >= 3, F.col(r))
    first = [kind("k:", F.col("k1")), kind("w:", core_key(F.col("w1"))), *([] if strict else [kind("a:", short("r1")), kind("o:", F.col("o1"))])]
    second = [kind("k:", F.col("k2")), kind("w:", core_key(F.col("w2"))), *([] if strict else [kind("a:", F.col("o2")), kind("o:", short("r2"))])]
    keyed = lambda side, keys: side.select("*", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    same = (F.col("k1") == F.col("k2")) | same_tokens(F.col("w1"), F.col("w2"))
    if not strict:
        same = same | F.coalesce(short("r1") == F.col("o2"), F.lit(False)) | F.coalesce(short("r2") == F.col("o1"), F.lit(False))
    found = [keyed(x, first).join(keyed(y, second), "key").where(same)]
    if not strict:
        both = lambda side, n: side.select("*", F.explode(F.array_distinct(F.array(f"k{n}", f"o{n}"))).alias(f"m{n}"))
        xs, ys = both(x, 1), both(y, 2)
        of = lambda sort: (F.col("m1") == F.col(f"{sort}1")) & (F.col("m2") == F.col(f"{sort}2"))  # noqa: E731  both group keys, or both own keys
        for inner, outer, k, m in ((xs, ys, "m1", "m2"), (ys, xs, "m2", "m1")):
            pairs = contained_keys(inner, outer, k, m).where(F.col(m).contains(F.col(k)) & (F.col(k) != F.col(m)))
            found.append(pairs.join(xs, "m1").join(ys, "m2").where(of("k") | of("o")))
        by_words = lambda p, q: p.join(q, core_key(F.col("w1")) == core_key(F.col("w2"))).where(same_tokens(F.col("w1"), F.col("w2")))
        other = with_nfkc(aliases.names, "name", "_c").select(F.col("canon"), F.col("name").alias("alias"), org_tokens(F.col("_c")).alias("said"))
        found.append(by_words(x.join(other, F.col("k1") == F.col("canon")).where(F.col("alias") != F.col(a)).select(a, F.col("said").alias("w1")), y))
        found.append(by_words(x, y.join(other, F.col("k2") == F.col("canon")).where(F.col("alias") != F.col(b)).select(b, F.col("said").alias("w2"))))
    return reduce(DataFrame.unionByName, [df.select(a, b) for df in found]).distinct()


def where_same_org(rows: DataFrame, a: str, b: str, aliases: Aliases) -> DataFrame:
    """The rows whose two names are strictly one organisation's: as match_orgs(strict=True), within the row."""
    x = described(rows, a, aliases).select(F.col(a), F.col("canonical").alias("_k1"), F.col("words").alias("_w1"))
    y = described(rows, b, aliases).select(F.col(b), F.col("canonical").alias("_k2"), F.col("words").alias("_w2"))
    same = (F.col("_k1") == F.col("_k2")) | same_tokens(F.col("_w1"), F.col("_w2"))
    return rows.join(x, a).join(y, b).where(same).select(*rows.columns)


def match_domains(left: DataFrame, official: DataFrame, domain: str, host: str) -> DataFrame:
    """Distinct pairs (domain, host): mail domains and the official ones that they belong to."""
    below = left.select(domain).distinct().select(domain, F.explode(suffixes(F.col(domain))).alias("d"))
    above = official.select(host).distinct().select(host, F.explode(accepted_domains(F.col(host))).alias("d"))
    return below.join(above, "d").select(domain, host).distinct()
