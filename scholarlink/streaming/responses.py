"""A store of the newest response of each key, kept while responses arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.records import RETRIED, is_kept, latest_responses

STATE = "json string, at timestamp"
OUT = "key string, json string, at timestamp"


class Newest(StatefulProcessor):
    """State of a key: its newest response, which goes `ttl_seconds` after its own time, when the stream's time has come that far."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank = lambda at, json: (at, json is not None, json or "")
        old = self.newest.get() if self.newest.exists() else None
        best = None if old is None else (pd.Timestamp(old[1]), old[0])
        for some in rows:
            for json, at in zip(some["json"], some["at"], strict=True):
                json, at = (None if pd.isna(json) else json), pd.Timestamp(at)
                if best is None or rank(at, json) > rank(*best):
                    best = (at, json)
        due = int(best[0].tz_localize("UTC").timestamp() * 1000) + self.ttl_ms + 1 if best[0].tzinfo is None else int(best[0].timestamp() * 1000) + self.ttl_ms + 1
        if due <= timerValues.getCurrentWatermarkInMs():  # come too late to be of use
            return
        if old is None or best != (pd.Timestamp(old[1]), old[0]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            self.newest.update((best[1], best[0].to_pydatetime()))
            yield pd.DataFrame({"key": [key[0]], "json": pd.Series([best[1]], dtype=object), "at": [best[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def newest_responses(log: DataFrame, ttl_seconds: int, late_seconds: int = 0, retried: tuple[str, ...] = RETRIED) -> DataFrame:
    """A stream (key, json, at) -> a row (key, json, at) each time that a key has a newer response. Needs the RocksDB state store.

    The state holds one response a key and forgets it when it is older than `ttl_seconds` at the stream's time, which is the newest
    `at` seen less `late_seconds`; rows may come in any order within that. Failures are nulls, stored as latest_responses() says.
    """
    stored = log.where("at is not null and key is not null").where(is_kept(F.col("key"), F.col("json"), retried)).withWatermark("at", f"{late_seconds} seconds")
    return stored.select("key", "json", "at").groupBy("key").transformWithStateInPandas(Newest(ttl_seconds), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def keep(log: DataFrame, path: str, checkpoint: str, ttl_seconds: int, late_seconds: int = 0, retried: tuple[str, ...] = RETRIED):
    """A writer of the stream's newest responses that appends each batch to the change files under `path`; compact() makes one set of them."""
    return newest_responses(log, ttl_seconds, late_seconds, retried).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(path))


def compact(changes: DataFrame, path: str, ttl_seconds: int, now, files: int = 1) -> None:
    """One Parquet file set of the responses that are still good at `now`, from the change files: as latest_responses() of the whole log."""
    latest_responses(changes, ttl_seconds, F.lit(now)).repartition(files, "key").write.mode("overwrite").parquet(path)
