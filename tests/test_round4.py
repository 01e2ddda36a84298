"""Cases that earlier rounds got wrong."""

from __future__ import annotations

import datetime
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarlink.jobs.queries import ORACLES
from scholarlink.llm import neighbours
from scholarlink.operators import evidence
from scholarlink.sources.jats import parse_jats
from scholarlink.sources.records import latest_responses


def test_parts_of_a_second_count_for_the_age_of_a_response(spark):
    now = datetime.datetime(2024, 1, 2, 0, 0, 0, 900_000)
    day = datetime.timedelta(seconds=86400)
    rows = [("page:old", "a", now - day - datetime.timedelta(microseconds=1)), ("page:older", "b", now - day - datetime.timedelta(milliseconds=800)), ("page:just", "c", now - day)]
    log = spark.createDataFrame(rows, "key string, json string, at timestamp")
    assert [r.key for r in latest_responses(log, 86400, F.lit(now)).collect()] == ["page:just"]


def _recall(spark, x: np.ndarray) -> float:
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = neighbours.usable(df)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = defaultdict(set)
    for r in neighbours.search(vectors, queries).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        exact = (x * x[q]).sum(axis=1)
        exact[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), -exact))[:20].tolist()))
    return hits / (20 * len(range(0, len(x), 20)))


def _tight(r, n: int, group: int) -> np.ndarray:
    """Vectors at random, of which a group are near copies of one."""
    x = r.normal(size=(n, 64))
    x[:group] = x[0] + 1e-3 * r.normal(size=(group, 64))
    return x


CASES = {
    "a tight group among others": lambda r: _tight(r, 6000, 3000),
    "groups of near copies": lambda r: np.repeat(r.normal(size=(4, 64)), 1500, axis=0) + 1e-3 * r.normal(size=(6000, 64)),
    "many dimensions": lambda r: r.normal(size=(4000, 512)),
    "very uneven lengths": lambda r: r.normal(size=(6000, 64)) * r.lognormal(0, 3, size=(6000, 1)),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_neighbours_however_vectors_lie(spark, case):
    assert _recall(spark, CASES[case](np.random.default_rng(7))) >= 0.999


def test_articles_of_one_small_file_are_parsed_by_many_tasks(spark):
    articles = spark.createDataFrame([(k, "<article/>") for k in range(20)], "doc_id long, xml string").coalesce(1)
    assert parse_jats(articles).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tasks(plan) -> int:
    """How many tables of a plan are dealt by url, over a number of tasks that isn't merged."""
    return plan._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [url")


def test_texts_and_pages_are_dealt_before_they_are_searched(spark):
    reads, names = spark.createDataFrame([(1, "u")], "person_id long, url string"), spark.createDataFrame([(1, ["Ann Lee"])], "person_id long, names array<string>")
    texts = spark.createDataFrame([("u", "pdf", "Ann Lee <alee@x.example>")], "url string, kind string, text string")
    found = evidence.by_full_text(reads, texts, names)
    assert _tasks(found) == 2 and [r.email for r in found.collect()] == ["alee@x.example"]
    pages = spark.createDataFrame([("u", 200, "text/html", "Ann Lee alee@x.example")], "url string, status int, content_type string, html string")
    found = evidence.by_home_page(reads.selectExpr("person_id", "0 as pos", "url"), pages, names, spark.createDataFrame([], "person_id long, domain string"))
    assert _tasks(found) == 2 and [r.email for r in found.collect()] == ["alee@x.example"]


def test_records_of_bibliographic_evidence_have_the_authors_of_many_orders(spark):
    assert "o_orderkey % 4000" in ORACLES["j8_bibliographic_evidence"]
    works = spark.createDataFrame([(k, "d") for k in range(3)], "person_id long, key string")
    names = spark.createDataFrame([(0, "Ann Lee"), (1, "A. Lee"), (2, None)], "person_id long, name string")
    authors = spark.createDataFrame([("d", "LEE Ann", "a@x.example"), ("d", "Bo Kim", "b@x.example"), ("e", "Ann Lee", "c@x.example"), ("d", None, "d@x.example")], "key string, author string, email string")
    assert sorted((r.person_id, r.email) for r in evidence.by_author(works, authors, names, "bibliography").collect()) == [(0, "a@x.example"), (1, "a@x.example")]
