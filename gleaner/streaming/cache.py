"""A cache with times to live as state of a stream: which requests it answers, which it lets through.

Each item's entry (outcome, time of fetching) is a value of its own in the state store, with a timer at the end of its life: verdicts live
6 hours, fetches without data 30 minutes, errors 60 seconds. A request that finds a living entry is a hit and changes nothing; any other is a miss, whose
outcome becomes the entry. Whether an entry lives is decided by the request's own time; the timer only frees the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.schedule import ERROR_TTL_S, NO_DATA_TTL_S, VERDICT_TTL_S

TTL_S = {"verdict": VERDICT_TTL_S, "no-data": NO_DATA_TTL_S, "error": ERROR_TTL_S}
OUT = "item_id {0}, event_id long, ts timestamp, outcome string, hit boolean"


class TtlCache(StatefulProcessor):
    """One item's entry. Rows of a micro-batch are taken in order of time, then of event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "outcome string, until_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["us", "event_id"])
        outcome, until = self.entry.get() if self.entry.exists() else (None, None)
        before, hits = until, []
        for us, kind in zip(got["us"], got["outcome"]):
            hit = until is not None and us < until
            hits.append(hit)
            if not hit:
                outcome, until = kind, int(us) + TTL_S[kind] * 1_000_000
        if until != before:
            self.entry.update((outcome, int(until)))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-int(until) // 1000))
        yield pd.DataFrame({"item_id": [key[0]] * len(got), "event_id": got["event_id"].to_numpy(), "ts": got["ts"].to_numpy(), "outcome": got["outcome"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of requests (item_id, event_id, ts, outcome: what a fetch at that time would give) with ``hit``.

    Requests later than ``late`` behind the newest one are dropped by the watermark. The state store must keep several columns (the RocksDB one).
    """
    kind = requests.schema["item_id"].dataType.simpleString()
    rows = requests.withWatermark("ts", late).select("item_id", "event_id", "ts", "outcome", F.unix_micros("ts").alias("us"))
    return rows.groupBy("item_id").transformWithStateInPandas(TtlCache(), OUT.format(kind), "Append", "EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
