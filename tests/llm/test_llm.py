"""The ten operators against brute force on small corpora that hold nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlink.llm import decontaminate, jaccard, language, line_dedup, neighbours, packing, phrases, quality, secrets, sharding

EXTRA = "n_words long, shard int, slot long, score double, pos int, h long, c long, n int, label string, text_crc32 long, size long, items string, row long, d string, g string, at int"


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 6))) for _ in range(120)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = ["\n".join(line(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    shared, header = line(70), line(9) + "\n" + line(6)
    out = base + base[:6] + base[:2]  # exact copies
    for t in base[:8]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "zzz"
        out.append(" ".join(w))
    out += [f"{line(20)} {shared} {line(15)}" for _ in range(8)] + [header + "\n" + line(30) for _ in range(6)]
    out += ["sh " * 300, "sh " * 280, "Sh " * 300, "", "  ", "\n\n", "one", "é ß Ü ñ", "ONE", "two words", None, None]
    out.append(" ".join(line(50) for _ in range(400)))  # a long one
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k * 3, t) for k, t in enumerate(texts())] + [(None, texts()[0]), (None, None)]
    rows += [rows[5], rows[5], rows[40]]  # rows that repeat
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = [f.split() for f in EXTRA.split(", ")]
    return df.select("*", *[F.lit(None).cast(k).alias(n) for n, k in names]).repartition(5).cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, {EXTRA}")


def test_line_dedup(corpus, empty):
    docs, rows = corpus
    places = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    split = {p: p[2].split("\n") for p in places}
    first, gone = {}, defaultdict(set)
    for p in places:
        for k in range(len(split[p]) - 1):
            window = tuple(split[p][k : k + 2])
            if first.setdefault(window, (p, k)) != (p, k):
                gone[p] |= {k, k + 1}
    want = Counter()
    for i, t in rows:
        p = (i is not None, i or 0, t)
        kept = None if t is None else "\n".join(x for k, x in enumerate(split[p]) if k not in gone[p])
        want[i, len(split[p]) if t is not None else 0, len(gone[p]) if t is not None else 0, kept] += 1
    out = line_dedup.drop_repeated_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()) == want
    assert set(docs.columns) <= set(out.columns)
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    runs = out.where("n_removed > 0").select(F.explode("runs").alias("r")).select("r.*").collect()
    assert runs and all(r.n_lines >= 1 for r in runs)


@pytest.mark.parametrize("least", [1, 3, 5])
def test_line_dedup_of_any_least_run(spark, least):
    rng = random.Random(least)
    rows = [(k, "\n".join(rng.choices("abc", [6, 3, 1], k=rng.randint(1, 30)))) for k in range(25)]
    first, want = {}, {}
    for i, t in rows:
        w, gone = t.split("\n"), set()
        for k in range(len(w) - least + 1):
            if first.setdefault(tuple(w[k : k + least]), (i, k)) != (i, k):
                gone |= set(range(k, k + least))
        want[i] = "\n".join(x for k, x in enumerate(w) if k not in gone)
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=least).collect()
    assert {r.doc_id: r.text for r in out} == want
    text = {i: t.split("\n") for i, t in rows}
    for r in out:
        assert sum(x.n_lines for x in r.runs or []) == r.n_removed
        for x in r.runs or []:
            assert text[r.doc_id][x.start : x.start + x.n_lines] == text[x.source_doc_id][x.source_line : x.source_line + x.n_lines]


def test_line_dedup_of_long_runs_grows_with_the_lines(spark):
    same = "\n".join(f"line {k}" for k in range(20_000))
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame([(1, same), (2, same + "\nend")], "doc_id long, text string")).collect()}
    assert out[1].n_removed == 0 and out[2].text == "end"
    assert [tuple(x) for x in out[2].runs] == [(0, 20_000, 1, 0)]


def test_long_single_lines_and_whole_documents_go(spark, empty):
    import corpus_pipeline

    long_, short = " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"a\n{long_}\nb\n{short}"), (2, f"c\n{long_}\nd"), (3, f"{short}\ne"), (4, long_), (5, "only this"), (6, "only this"), (7, "f\nonly this\ng"), (8, ""), (9, ""), (10, f"h\n{long_}\n{short}\nh"), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'x' as source", "length(text) as n_chars")
    want = dict(rows) | {2: "c\nd", 10: f"h\n{short}\nh", 4: "", 6: ""}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, long_words=50).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == dict(rows)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {k: v for k, v in want.items() if k not in (4, 6)}
    assert line_dedup.drop_repeated_lines(empty, long_words=50).count() == 0


def test_sharding(corpus, empty):
    docs, rows = corpus
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == len(rows)
    home, load = {}, Counter()
    for r in out:
        assert home.setdefault(r.group, r.shard) == r.shard
        load[r.shard] += r.size
    for s in load:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = Counter()
    for i, t in rows:
        sizes[t] += len(t.encode()) + 1 if t is not None else 1
    loads = [0] * 4
    for n in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += n
    assert sorted(load.values()) == sorted(x for x in loads if x)
    assert Counter((r.doc_id, r.text_crc32) for r in out) == Counter((i, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert sharding.shard_documents(empty, 4).count() == 0


def test_sharding_of_large_groups(spark):
    sizes = [10**6 + 7 * k for k in range(40)] + [70_000] * 50 + [3] * 1000 + [90_000_000]
    df = spark.createDataFrame([(bytearray(str(k).encode()), s) for k, s in enumerate(sizes)], "g binary, size long")
    load = Counter()
    for r in sharding.shard_groups(df, 8).collect():
        load[r.shard] += r.size
    assert sum(load.values()) == sum(sizes) and max(load.values()) == 90_000_000
    rest = sorted(load.values())[:-1]
    assert rest[-1] - rest[0] <= 0.02 * rest[-1]


def test_deal_is_greedy():
    rng = random.Random(3)
    for _ in range(50):
        classes = sorted(((rng.randint(1, 50), rng.randint(1, 200)) for _ in range(5)), reverse=True)
        loads = [float(rng.randint(0, 300)) for _ in range(3)]
        want = list(loads)
        for s, n in classes:
            for _ in range(n):
                want[want.index(min(want))] += s
        got = list(loads)
        for key, share in sharding.deal(list(loads), [(k, n, float(s)) for k, (s, n) in enumerate(classes)]).items():
            for i, n in enumerate(share):
                got[i] += n * classes[key][0]
        assert sorted(got) == sorted(want)


def test_quality(spark, corpus, empty):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs, ratings = [], []
    for k in range(2400):
        t = rng.choices(words, k=40)
        g = rng.choice([0, 1, 2, 2, 2])
        if g == 0:
            t.insert(3, rng.choice(["awful", "nasty"]))
        if g == 1:
            t += ["###"] * 5
        docs.append((k, " ".join(t)))
        ratings.append((k, g if k < 1800 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.learn(df, spark.createDataFrame(ratings, "doc_id long, grade int"))
    assert (np.diff(model.thresholds) > 0).all()
    grades = {k: (0 if "awful" in t or "nasty" in t else 1 if "###" in t else 2) for k, t in docs}
    got = quality.grade(df, model).where("doc_id >= 1800").collect()
    assert np.mean([(r.tails[0] < 0.5) == (grades[r.doc_id] == 0) for r in got]) > 0.95
    assert np.mean([(r.expected_grade > 1.5) == (grades[r.doc_id] == 2) for r in got]) > 0.95
    docs, rows = corpus
    assert quality.grade(docs, model).count() == len(rows)
    none = quality.learn(empty, spark.createDataFrame([], "doc_id long, grade int"))
    assert quality.grade(docs, none).where("expected_grade != 0").count() == 0


def test_substring_dedup(corpus, empty):
    docs, rows = corpus
    window, first = 50, {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    want = Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.repeated_words(docs).collect()) == want
    assert sum(x[2] for x in want) > 500
    assert phrases.repeated_words(empty).count() == 0


def test_anchors_hit_every_window():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 35):
        g = rng.integers(0, 9, 300).astype(np.uint64)
        places, counts = phrases.anchors(g, width)
        want = [k + int(np.argmin(g[k : k + width])) for k in range(300 - width + 1)]
        assert np.repeat(places, counts).tolist() == want


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    odd = ["", " ", "  a  b\n\n c ", " x", "x ", "a \n b", "it's we'll  don't", "日本 語 x  y", "　a b", "tab\t x", "x\r\n y 12 345 !!! ??", "a <|endoftext|> b"]
    many = [x or "" for x in texts()] + odd
    assert packing.Encoder(tokenizer).ids(many) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(many, add_special_tokens=False)]


def test_packing_knows_added_tokens(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    held = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "a <|endoftext| > b", "plain text"]
    assert t.encode(held[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = [(k, np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, x in enumerate(held)]
    out = packing.pack(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), tokenizer).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in out) == Counter((k, len(b) // 4, zlib.crc32(b)) for k, b in want)


def test_packing(corpus, empty, tokenizer):
    docs, rows = corpus
    out = packing.pack(docs, tokenizer, capacity=64).collect()
    ids = [(i, packing.Encoder(tokenizer).encode([t or ""])[0] + bytes(4)) for i, t in rows]
    want = Counter()
    for i, b in ids:
        n = len(b) // 4
        stops = list(range((n - 1) % 64 + 1, n + 1, 64))
        for p, stop in enumerate(stops):
            start = stops[p - 1] if p else 0
            want[i, p, start, stop - start, zlib.crc32(b[start * 4 : stop * 4])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= sum(x[3] * c for x, c in want.items()) / 64 * 1.1 + 2
    assert packing.pack(empty, tokenizer).count() == 0


def test_best_fit_is_decreasing_and_tightest():
    rng = random.Random(4)
    for _ in range(100):
        cap = rng.choice([5, 16, 31, 64])
        lengths = np.array([rng.randint(1, cap) for _ in range(150)])
        left: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [(r, k) for k, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits)[1]] -= n
            else:
                left.append(cap - n)
        assert packing.best_fit(lengths, cap)[0].max() + 1 == len(left)


def test_decontamination(spark, corpus, empty):
    docs, rows = corpus
    long_ = [t for t in texts() if t and len(t.split()) > 40]
    items = [(str(k), " ".join(t.split()[5:25])) for k, t in enumerate(long_[:6])] + [("7", "sh sh sh"), ("8", "two, WORDS"), ("9", None), ("10", "..."), ("11", "no such thing"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    patterns = defaultdict(set)
    for i, t in items:
        w = decontaminate.words_of(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            patterns[tuple(w[k : k + 10])].add(i)
    want = Counter()
    for i, t in rows:
        w, hit, found = decontaminate.words_of(t), set(), set()
        for p, who in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= who
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    for block in (decontaminate.BLOCK_WORDS, 30):
        out = decontaminate.find_contamination(docs, bench, block_words=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == want
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in out)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_near_duplicates(corpus, empty):
    docs, rows = corpus
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = i if least[root(k)] is None else min(i, least[root(k)])
    want = Counter((i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == want
    assert jaccard.near_duplicates(empty).count() == 0


def test_candidate_classes_stay_off_the_driver(spark, monkeypatch):
    words = [f"a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(700)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(words)], "doc_id long, text string")
    want = {k: jaccard._signed(jaccard.grams(t, 5)).tolist() for k, t in enumerate(words[:600])}
    classes = spark.createDataFrame([(k, t, *jaccard.signature(jaccard.grams(t, 5))) for k, t in enumerate(words[:600])], "c long, text string, c1 long, c2 long")
    wanted = classes.select("c", F.xxhash64("text").alias("t"), "c1", "c2")
    fetched, kind = [], type(docs)

    def counted(name):
        real = getattr(kind, name)

        def run(self, *args):
            rows = real(self, *args)
            fetched.append(len(rows))
            return rows

        monkeypatch.setattr(kind, name, run)

    counted("toPandas")
    counted("collect")
    sets = jaccard._sets(docs, wanted, 5)
    assert fetched and max(fetched) <= 256
    monkeypatch.undo()
    assert {r.c: r.grams for r in sets.collect()} == want


def test_near_duplicates_of_the_pipeline_go_by_row(spark):
    import corpus_pipeline

    rng = random.Random(12)
    a, b, c, d = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " zzz"
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, near), (7, d), (7, d), (5, d), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'x' as source", "length(text) as n_chars").repartition(3)
    out = corpus_pipeline.near_duplicate(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (None, b), (2, c), (5, d), (3, ""), (3, ""), (4, None)])


def test_secrets(spark, corpus, empty):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    filler = lambda: " ".join(rng.choices(["alpha", "beta", "considerations", "internationalisation", "gamma"], k=30))
    rows = []
    for k in range(240):
        kind = k % 4
        mid = [f'token = "{digits(40)}"', f"card {rng.randint(10**15, 10**16 - 1)}", f"see /usr/share/documentation/{digits(4)}", f"password={digits(18)}"][kind]
        rows.append((k, f"{filler()} {mid} {filler()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as candidate")
    out = secrets.scan(df).collect()
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in out)
    flagged = {r.doc_id for r in out if r.is_secret}
    assert flagged == {k for k in range(240) if k % 4 in (0, 3)}
    docs, _ = corpus
    assert secrets.scan(docs).where("is_secret").count() == 0
    assert secrets.scan(empty).count() == 0


def test_features_of_candidates(spark):
    common = ["harbour", "meadow", "lantern"]
    docs = spark.createDataFrame([(k, " ".join(common)) for k in range(20)] + [(20, "see harbour/meadow-0x1/lantern and Zq9Zq9xxZQqzqxj7Kv and 0123456789012345")], "doc_id long, text string")
    words = secrets.dictionary(docs)
    cost = {r.pair: r.cost for r in secrets.transitions(words).collect()}
    assert cost["ha"] == 0 and abs(cost["rn"] - np.log(2)) < 1e-9  # after r, n once and nothing else but the end: b, o, n ...
    found = {r.candidate: r for r in secrets.featured(secrets.candidates(docs), words).collect()}
    path, odd, digits = found["harbour/meadow-0x1/lantern"], found["Zq9Zq9xxZQqzqxj7Kv"], found["0123456789012345"]
    assert path.covered == (7 + 6 + 7) / 26 and odd.covered == digits.covered == 0
    assert path.unlikely < 2 < odd.unlikely == digits.unlikely == secrets.UNSEEN
    assert odd.to_digit == 3 / 18 and odd.from_digit == 3 / 18 and odd.rises == 1 / 18 and digits.changes == 0


def test_secrets_of_a_megabyte(spark):
    long_ = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=1_000_000))
    docs = spark.createDataFrame([(1, f"data:{long_} end")] + [(k, "harbour meadow") for k in range(2, 30)], "doc_id long, text string")
    found = secrets.scan(docs).collect()
    assert [(r.doc_id, r.start, r.candidate == long_) for r in found] == [(1, 5, True)]


def test_dictionary_counts_documents_without_candidates(spark):
    rows = [(k, "Harbour meadow harbour, straßen; considerations") for k in range(19)] + [(19, "harbour straßen " + "0a" * 20), (20, "meadows"), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word for r in secrets.dictionary(df).collect()} == {"harbour", "straßen"}
    assert {r.word for r in secrets.dictionary(df, common=19).collect()} == {"harbour", "straßen", "meadow"}


def test_secrets_after_long_names_and_short_ones(spark):
    rng = random.Random(10)
    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    names = ["aws_secret_access_key", "google_client_secret", "github_access_token"]
    rows, values = [], {}
    for k in range(240):
        name, long_, short = names[k % 3], digits(40), digits(7) + str(k % 10) * (1 + k % 8)
        mid, values[k] = [(f'{name} = "{long_}"', long_), (f"password={short}", short), (f'"api_key": "{short}"', short), (f"see {name} and /usr/share/{name}", None), (f"PWD = '{short}!x#'", short + "!x#"), (f"pages={short}", None)][k % 6]
        rows.append((k, f"alpha beta internationalisation {mid} gamma considerations"))
    text = dict(rows)
    text[240] = "x" * 16 + " " + "\n".join(f"token={digits(8)}" for _ in range(40)) + " é " + "y" * 70 + "." + "z" * 20
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = secrets.candidates(df).collect()
    assert all(text[r.doc_id][r.start : r.start + len(r.candidate)] == r.candidate for r in found)
    assert all(r.before == text[r.doc_id][max(0, r.start - 60) : r.start] for r in found)
    assert all(r.after == text[r.doc_id][r.start + len(r.candidate) :][:20] for r in found)
    assert sum(r.doc_id == 240 for r in found) == 43
    flagged = {(r.doc_id, r.candidate) for r in secrets.scan(df).collect() if r.is_secret and r.doc_id < 240}
    assert flagged == {(k, v) for k, v in values.items() if v}


def test_language(spark, corpus, empty):
    rng = random.Random(6)
    speech = {"xx": "thor ing and the of tion".split(), "yy": "eau elle ment que aux".split(), "zz": "ung keit sch ver der".split()}
    say = lambda s, n: " ".join("".join(rng.choices(speech[s], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, say(s := rng.choice(list(speech)), rng.randint(3, 60)), s) for k in range(400)]
    rows += [(1000, None, "xx"), (1001, "123 ... !", "yy"), (1002, "", None), (None, say("xx", 9), "xx"), (1003, say("yy", 3000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, segments=True).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002)) and got[1003].lang_pred == "yy"
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == s for i, _, s in held]) >= 0.97 and all(got[i].held_out for i, *_ in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, say("xx", 20) + " " + say("zz", 25))], "doc_id long, text string")
    parts = language.label(mixed, language.learn(df, F.lit(True)), segments=True).first().segments
    assert parts[0].lang == "xx" and parts[-1].lang == "zz" and sum(p.n_words for p in parts) == 45 and len(parts) <= 6
    docs, rows = corpus
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred = 'und'").count() == len(rows)
    assert language.identify(empty).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(8)
    e, lengths, t = rng.normal(size=(9, 3)).astype(np.float32), np.array([4, 1, 4]), rng.normal(size=(3, 3)).astype(np.float32)
    got, at = language.forward_backward(e, lengths, t), 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(e[at + k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            for k, y in enumerate(path):
                total[k, y] += w
        np.testing.assert_allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_transitions_get_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(9)
    e, lengths, t = rng.normal(size=(8, 3)).astype(np.float32), np.array([3, 1, 4]), rng.normal(size=(3, 3)).astype(np.float32)

    def log_z(t):
        at, out = 0, 0.0
        for n in lengths:
            paths = [sum(e[at + k, y] for k, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*[3] * n)]
            out, at = out + np.log(np.exp(np.array(paths, np.float64)).sum()), at + n
        return out

    got = np.zeros((3, 3), np.float32)
    language.forward_backward(e, lengths, t, got)
    want = np.zeros((3, 3))
    for a in range(3):
        for b in range(3):
            step = np.zeros((3, 3))
            step[a, b] = 1e-4
            want[a, b] = (log_z(t + step) - log_z(t - step)) / 2e-4
    np.testing.assert_allclose(got, want, atol=2e-3)


def _recall(spark, x: np.ndarray, **how) -> float:
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = neighbours.usable(df)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = defaultdict(set)
    for r in neighbours.search(vectors, queries, **how).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-exact)[:20].tolist()))
    return hits / (20 * len(range(0, len(x), 20)))


def test_neighbours_of_plain_and_uneven_vectors_in_large_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    assert _recall(spark, x, cells=20) >= 0.9  # cells of several hundred, of which a query measures 300 vectors
    assert _recall(spark, x * rng.lognormal(0, 1, size=(8000, 1)), cells=20, block=1500) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_of_the_given_tables(spark, sf):
    import os

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no table")
    from scholarlink.llm import queries

    rows = spark.read.parquet(path).orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    got = defaultdict(set)
    for r in queries.op10_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    hits = 0
    for q in asked:
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-exact)[:20]].tolist()))
    assert set(got) == set(ids[asked].tolist()) and hits / (20 * len(asked)) >= 0.9


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[100:700] = x[100]  # one very common vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(9000, None), (9020, [0.0] * 12), (9040, [float("nan")] + [1.0] * 11), (9060, [None] + [1.0] * 11), (9080, [1.0]), (None, [1.0] * 12), (9100, [float("inf")] * 12)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("cell", F.lit(1))
    vectors = neighbours.usable(df)
    assert vectors.count() == 1500
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = defaultdict(dict)
    for r in neighbours.search(vectors, queries, k=20, block=300).collect():
        got[r.query_id][r["rank"]] = r.vec_id, r.score
    x64, hits = x.astype(np.float64), 0
    for q in range(0, 1500, 20):
        exact = (x64 * x64[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(1500), -exact)) if k != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(exact[v] == s and v != q for v, s in got[q].values())
        mine = [got[q][k] for k in range(1, 21)]
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        hits += len({v for v, _ in mine} & set(order))
    assert hits / (75 * 20) >= 0.9
    few = vectors.where("vec_id < 5")
    assert neighbours.search(few, queries.where("query_id = 0"), k=20).count() == 4
    assert neighbours.search(vectors.limit(0), queries.limit(0)).count() == 0
