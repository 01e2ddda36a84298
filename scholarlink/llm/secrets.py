"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations only.

A candidate is a run of 16 or more letters, digits and + / _ -, or a value of 8 or more of these and ! @ # $ % ^ & * ? ~ that
directly follows a credential's name and an assignment, so that short passwords are looked at as well. Its features are its length, its transitions: how often
it changes between lower case, upper case, digits and signs, by kind of change, and how unlikely its pairs of letters are after
the words of the dictionary; then how much of it dictionary words cover, whether it looks like part of a path, and what its
neighbouring words are: a name that credentials go by, an equals sign, a quotation mark. The dictionary holds the words of four
to eight letters that at least `common` documents have, with candidates or without.

Pieces of a candidate go by a 128-bit hash of it, not with the candidate, so a long one costs no more than its length.

The forest is trained on labelled findings (candidate features and is_secret), on about `sample` of them picked by a hash of
document and place, half of either label where there are enough. Where nobody has labelled findings, planted() makes some: it
writes statements into words of the documents themselves, some with a secret of one of SECRETS kinds, some with what only looks like one
(DECOYS kinds), and knows each label because it put the value there. Secrets stand without a credential's name as well, and decoys after one,
so no single feature tells them apart; documents with crc32 mod 4 = 2 and whole kinds can be held out to measure what was learnt.

Nulls, empties, repeats: a null or empty text has no candidates. Repeated rows have theirs reported as often as they come.
Without findings of both kinds no forest can be grown; every candidate then keeps the share of secrets among the findings
(0 without any) as its score. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, stash

RUN = r"[A-Za-z0-9+/_\-]"
#: Names that credentials go by.
KEYS = r"(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|credential|auth)"
#: Where the value assigned to such a name begins; the short test of the first look-behind spares most places the second.
VALUE = r"(?<=[=:]\s{0,3}[\"']?)(?<=" + KEYS.replace("(?i)(", "(?i:", 1) + r"\S{0,20}\s{0,3}[=:]\s{0,3}[\"']?)"
CANDIDATE = rf"(?<!{RUN})(?:{VALUE}[A-Za-z0-9+/_\-!@#$%^&*?~]{{8,}}+|{RUN}{{16,}}+)"
FEATURES = ["length", "digits", "upper", "changes", "rises", "to_digit", "from_digit", "unlikely", "distinct", "covered", "path", "key", "assigned", "quoted"]
GRAMS = range(4, 9)
#: What a pair of letters costs that the dictionary doesn't have; no pair costs more.
UNSEEN = 12.0


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row, nth (from 0), start (character, from 0), candidate, before and after (up to 60 and 20 characters of the text beside it, other candidates included)."""
    rows = only(docs, "doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE, -1).alias("p"))
    both = F.arrays_zip(F.col("c"), F.slice("p", 1, F.size("c")).alias("pre"), F.slice("p", 2, F.size("c")).alias("post"))
    each = rows.select("doc_id", "row", F.posexplode(both).alias("nth", "x")).select("doc_id", "row", "nth", F.col("x.c").alias("candidate"), F.length("x.pre").alias("gap"), F.right("x.pre", F.lit(60)).alias("pre"), F.left("x.post", F.lit(20)).alias("post"))
    place = W.partitionBy("row").orderBy("nth")
    so_far = F.sum(F.col("gap") + F.length("candidate")).over(place)
    # a candidate has 8 characters or more, so 8 of them fill 60 characters and 3 fill 20
    left = F.collect_list(F.concat("pre", F.right("candidate", F.lit(60)))).over(place.rowsBetween(-8, -1))
    right = F.collect_list(F.concat(F.left("candidate", F.lit(20)), "post")).over(place.rowsBetween(1, 3))
    placed = each.select("*", so_far.alias("so_far"), left.alias("left"), right.alias("right"))
    before, after = F.right(F.concat(F.array_join("left", ""), "pre"), F.lit(60)), F.left(F.concat("post", F.array_join("right", "")), F.lit(20))
    return placed.select("doc_id", "row", "nth", (F.col("so_far") - F.length("candidate")).alias("start"), "candidate", before.alias("before"), after.alias("after"))


def dictionary(docs: DataFrame, common: int = 20) -> DataFrame:
    """(word, count): the lower-cased words of four to eight letters in at least `common` documents of the whole table."""
    word = rf"(?<!\p{{L}})\p{{L}}{{{GRAMS[0]},{GRAMS[-1]}}}+(?!\p{{L}})"
    words = only(docs, "text").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") >= common)


def transitions(words: DataFrame) -> DataFrame:
    """(pair, cost): minus the logarithm of how probable the second of two letters a-z is after the first; 676 rows at most."""
    pair = F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1)))
    pairs = words.select(pair.alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n"))
    after = F.sum("n").over(W.partitionBy(F.left("pair", F.lit(1))))
    return pairs.select("pair", F.least(F.log(after / F.col("n")), F.lit(UNSEEN)).alias("cost"))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """candidates with FEATURES."""
    code = F.unhex(F.md5(F.col("candidate").cast("binary")))
    found = found.withColumn("_code", code)
    distinct = found.select("_code", F.lower("candidate").alias("c")).dropDuplicates(["_code"])
    pieces = lambda n: distinct.select("_code", F.posexplode(F.regexp_extract_all("c", F.lit(f"(?=(.{{{n}}}))"), F.lit(1))).alias("at", "word")).where(F.col("word").rlike("^[a-z]+$"))
    grams = reduce(DataFrame.unionByName, [pieces(n) for n in GRAMS])
    hit = grams.join(words.select("word"), "word").select("_code", F.explode(F.sequence("at", F.col("at") + F.length("word") - 1)).alias("at")).distinct()
    covered = hit.groupBy("_code").agg(F.count(F.lit(1)).alias("n"))
    costs = pieces(2).join(F.broadcast(transitions(words)), F.col("word") == F.col("pair"), "left")
    costs = costs.groupBy("_code").agg(F.avg(F.coalesce("cost", F.lit(UNSEEN))).alias("cost"))
    known = found.join(covered, "_code", "left").join(costs, "_code", "left")
    return known.select(
        *[c for c in found.columns if c != "_code"],
        F.length("candidate").cast("double").alias("length"),
        _share("[0-9]").alias("digits"),
        _share("[A-Z]").alias("upper"),
        _share("(?=[a-z][^a-z]|[A-Z][^A-Z]|[0-9][^0-9]|[+/_-][^+/_-])").alias("changes"),
        _share("(?<=[a-z])[A-Z]").alias("rises"),
        _share("(?<=[A-Za-z])[0-9]").alias("to_digit"),
        _share("(?<=[0-9])[A-Za-z]").alias("from_digit"),
        F.coalesce("cost", F.lit(UNSEEN)).alias("unlikely"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("distinct"),
        (F.least(F.coalesce("n", F.lit(0)), F.length("candidate")) / F.length("candidate")).alias("covered"),
        (_share("/") + F.col("before").rlike(r"[./\\]$").cast("double")).alias("path"),
        F.col("before").rlike(KEYS + r"\S{0,20}\s{0,3}[=:]?\s{0,3}[\"']?$").cast("double").alias("key"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike(r"[\"']$").cast("double").alias("quoted"),
    )


SECRETS, DECOYS = 6, 8
#: What may stand before a value: names that credentials go by with an assignment or not, words that announce other things, nothing.
CREDENTIAL = ("token = \"", "secret: ", "api_key=", "password = '", "Authorization: Bearer ", "aws_secret_access_key = ", "auth_token: \"", "pwd=")
PUBLIC = ("commit ", "sha1:", "revision = ", "see ", "id=", "file ", "order no. ", "checksum: ")


def _planted_value(kind: Column, h: Column, word: list[Column]) -> Column:
    """A value of a kind, from 128 hexadecimal digits of a hash and four words."""
    mixed = F.base64(F.unhex(F.left(h, F.lit(96))))  # letters, digits, + and /
    dashed = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = lambda at, n: F.right(F.concat(F.lit("0" * n), F.conv(F.substring(h, at, 15), 16, 10)), F.lit(n))
    capital = [F.initcap(w) for w in word]
    made = [
        F.substring(h, 1, 40),
        F.substring(F.translate(mixed, "+/", "Qz"), 1, 32),
        F.substring(F.translate(mixed, "+/", "-_"), 1, 43),
        F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(mixed, "+/", "xy"), 1, 16))),
        F.when(F.substring(h, 30, 1) < "8", F.concat(capital[0], number(3, 4), F.lit("!"), F.substring(mixed, 5, 3))).otherwise(F.substring(F.when(F.substring(h, 31, 1) < "5", h).when(F.substring(h, 31, 1) < "b", mixed).otherwise(F.concat(number(3, 16), number(60, 16), number(80, 16))), F.lit(18), F.conv(F.substring(h, 32, 1), 16, 10).cast("int") + 8)),
        dashed,
        F.substring(h, 1, 40),
        F.concat(F.lit("/usr/"), word[0], F.lit("/"), word[1], F.lit("/"), F.when(F.substring(h, 30, 1) < "8", F.concat(word[2], F.lit("_"), word[3])).otherwise(F.substring(h, F.lit(33), F.conv(F.substring(h, 32, 1), 16, 10).cast("int") / 2 + 2))),
        F.concat(word[0], *capital[1:]),
        F.concat_ws("_", *word),
        number(3, 16),
        F.concat(*word[:3]),
        dashed,
        F.concat(F.lit("your_"), word[0], F.lit("_"), word[1], F.lit("_here")),
    ]
    return F.element_at(F.array(*made), kind + 1)


def planted(docs: DataFrame, sample: int = 3_000, each: int = 6, longest: int = 20_000) -> DataFrame:
    """doc_id (of the statement), text, kind, value, at, is_secret: about sample * each statements among words of documents of at most `longest` characters, picked by a hash.

    Kinds below SECRETS are secrets. A hexadecimal string or a dashed one is a secret after a credential's name or nothing, and none after what announces another thing.
    """
    rows = only(docs, "doc_id", "text").where(F.length("text").between(20, longest))
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / (1 << 30) * n < sample)
    rows = rows.select(F.col("doc_id").alias("source_id"), F.split("text", r"\s+").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit("planted"), "source_id", "k"), 512))
    draw = lambda at, most: F.pmod(F.conv(F.substring("h", at, 6), 16, 10).cast("long"), F.lit(most)).cast("int")
    plain = F.filter("w", lambda x: x.rlike("^[a-z]{3,9}$"))
    rows = rows.withColumn("plain", plain).where(F.size("plain") >= 3).withColumn("kind", draw(40, SECRETS + DECOYS)).withColumn("cut", draw(50, 1 << 20) % F.size("w"))
    word = [F.element_at("plain", F.pmod(draw(56 + 4 * k, 1 << 20), F.size("plain")) + 1) for k in range(4)]
    value = _planted_value(F.col("kind"), F.col("h"), word)
    named, public = (F.element_at(F.array(*[F.lit(x) for x in texts]), draw(80, len(texts)) + 1) for texts in (CREDENTIAL, PUBLIC))
    bare = draw(90, 4) == 0
    secret = F.col("kind") < SECRETS
    # a short password is a candidate only where it is assigned to a name; placeholders stand there as well
    before = F.when(F.col("kind").isin(4, SECRETS + DECOYS - 1), named).when(bare & ~F.col("kind").isin(0, 5, SECRETS, SECRETS + 6), "").when(secret, named).otherwise(public)
    left, right = (F.array_join(F.slice("w", x, 12), " ") for x in (F.col("cut") + 1, F.col("cut") + 13))
    rows = rows.select("source_id", "k", "kind", F.concat(left, F.lit(" "), before).alias("left"), value.alias("value"), F.concat(F.when(before.endswith('"'), '" ').when(before.endswith("'"), "' ").otherwise(" "), right).alias("right"), secret.alias("is_secret"))
    return rows.select((F.xxhash64("source_id", "k")).alias("doc_id"), "source_id", F.concat("left", "value", "right").alias("text"), "kind", "value", F.length("left").alias("at"), "is_secret")


def labelled(docs: DataFrame, words: DataFrame, sample: int = 3_000) -> DataFrame:
    """Findings with FEATURES, kind, source_id and is_secret: the candidates that are values planted into docs."""
    made = stash(planted(docs, sample), "planted")
    found = featured(stash(candidates(made), "planted-candidates"), words)
    known = made.select("doc_id", "source_id", "kind", F.col("value").alias("candidate"), F.col("at").alias("start"), "is_secret")
    return found.join(known, ["doc_id", "candidate", "start"])


def train(findings: DataFrame, sample: int = 20_000, trees: int = 40, depth: int = 10) -> PipelineModel | float:
    """A forest from findings (FEATURES, is_secret), or the share of secrets where they are all of one kind. About `sample` of them are looked at, and no more however many are alike."""
    rows = findings.where("is_secret is not null").withColumn("label", F.col("is_secret").cast("double"))
    n, secrets = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not secrets or secrets == n:
        return float(bool(n) and bool(secrets))
    place = [F.col(c) for c in ("doc_id", "start", "nth") if c in rows.columns] or [F.monotonically_increasing_id()]
    most = F.when(F.col("label") > 0, sample / 2 / secrets).otherwise(sample / 2 / (n - secrets))
    kept = stash(rows.where(F.pmod(F.xxhash64(*place, F.lit(4)), F.lit(1 << 30)) / (1 << 30) < most).select(*FEATURES, "label"), "findings")
    seen = kept.select("label").distinct().count()
    if seen < 2:  # one of a label that is hardly there may be missed; the forest then knows the other alone
        return secrets / n
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return PipelineModel([assembler, forest.fit(assembler.transform(kept))])


def score(found: DataFrame, model: PipelineModel | float) -> DataFrame:
    """featured candidates with score, the probability that it is a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    out = model.transform(found)
    return out.select(*found.columns, vector_to_array("probability")[1].alias("score"))


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, from which nothing is learnt."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, start, candidate, score, is_secret for all candidates of docs.

    findings are labelled candidates with FEATURES; without any, those planted into three quarters of the documents.
    """
    words = stash(dictionary(docs), "dictionary")
    found = stash(featured(stash(candidates(docs), "candidates"), words), "features")
    known = labelled(docs.where(~held_out(F.col("doc_id"))), words) if findings is None else findings
    return score(found, train(known)).select("doc_id", "nth", "start", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
