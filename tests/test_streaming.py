"""The store of newest responses: a stream in any order comes to the rows of the whole log."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scholarlink.sources.records import latest_responses
from scholarlink.streaming.responses import compact, keep

SCHEMA = "key string, json string, at timestamp"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def run(spark, folder, rows, batches, ttl, late):
    """The rows as a stream of some files in the order given, one file a batch."""
    log, changes = folder / "log", str(folder / "changes")
    log.mkdir()
    for k in range(batches):
        part = spark.createDataFrame(rows[k::batches], SCHEMA)
        part.coalesce(1).write.parquet(str(folder / f"part{k}"))
        file = next((folder / f"part{k}").glob("*.parquet"))
        file.rename(log / f"{k:03}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(log))
        query = keep(stream, changes, str(folder / "state"), ttl, late).trigger(availableNow=True).start()  # a new start each time: the state survives
        query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(changes)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree(spark, tmp_path, rocks, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.choice(['pdf', 'page'])}:{rng.randint(0, 8)}", rng.choice([None, "a", "b", "c"]), at(rng.randint(0, 500))) for _ in range(120)] + [("page:x", None, at(499)), ("page:x", "a", at(3)), ("pdf:y", None, at(499)), ("pdf:y", "a", at(490))]
    rng.shuffle(rows)
    ttl, now = 200, at(500)
    changes = run(spark, tmp_path, rows, 3, ttl, late=1000)
    compact(changes, str(tmp_path / "kept"), ttl, now)
    want = latest_responses(spark.createDataFrame(rows, SCHEMA), ttl, F.lit(now))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "kept")).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.key: r.json for r in want.collect()}["page:x"] is None  # a failure is remembered; of the kind that is tried again it isn't
    assert {r.key: r.json for r in want.collect()}["pdf:y"] == "a"


def test_old_responses_leave_the_state(spark, tmp_path, rocks):
    rows = [("page:a", "1", at(0)), ("page:b", "1", at(1000)), ("page:a", "0", at(5)), ("page:b", "2", at(1001))]
    changes = run(spark, tmp_path, rows, 4, ttl=60, late=10)
    # the second batch ends with the clock at 990, when page:a is long gone; what comes later for it is too late to be kept
    assert {(r.key, r.json) for r in changes.collect()} == {("page:a", "1"), ("page:b", "1"), ("page:b", "2")}
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "state"))
    assert {r["key"]["key"] for r in state.collect()} == {"page:b"}
