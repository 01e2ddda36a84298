"""Tests for the findings of round 3, third time."""

from scholarlink.llm import jaccard


def test_classes_that_meet_at_many_ngrams_stay_one_row_in_the_prefix_filter(spark, monkeypatch):
    """pipeline, near_duplicates: pairs are compared by one list of n-grams a class, made once, not by a row for each n-gram of each round; what is common is counted by weight."""
    made, lists = [], []
    near_enough, make = jaccard._near_enough, jaccard._lists
    monkeypatch.setattr(jaccard, "_near_enough", lambda pairs, percent: made.append({(r.a, r.b): r.common for r in pairs.collect()}) or near_enough(pairs, percent))
    rows = [(t, c, 1 + 2 * (t == 0)) for c in range(4) for t in range(60) if c < 3 or t < 50]  # 58 + 1 + 3 n-grams of three classes, 50 rows of the fourth
    met = spark.createDataFrame(rows, "token long, c long, weight int")
    pairs = spark.createDataFrame([(0, 1, 240, 240), (1, 3, 240, 240)], "a long, b long, n_a int, n_b int")
    found = make(met)
    assert {r.c: (len(r.ones), [tuple(x) for x in r.more]) for r in found.collect()} == {0: (59, [(0, 3)]), 1: (59, [(0, 3)]), 2: (59, [(0, 3)]), 3: (49, [(0, 3)])}
    jaccard._enough(pairs, found, 75).collect()
    assert made == [{(0, 1): 62, (1, 3): 52}]

    monkeypatch.setattr(jaccard, "_lists", lambda met: lists.append(met.count()) or make(met))
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[:280]), " ".join(words[:281]), " ".join(words[2:281]), " ".join(words[150:] + words[:20])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).select("doc_id", "component_id").collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert len(lists) == 1
