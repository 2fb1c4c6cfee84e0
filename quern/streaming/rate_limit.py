"""The rate limiter as a stream: one accepted call in `gap` microseconds for each user."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.state import keep_state_in_rocksdb

_OUT = "user_id long, event_id long, t long, accepted boolean"


class Limiter(StatefulProcessor):
    """Keeps one number for a user: the last accepted call, until the watermark is `gap` beyond it, when any call would be accepted."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = before = self.last.get()[0] if self.last.exists() else None
        for t, event_id in sorted((r["t"], r["event_id"]) for r in rows):
            accepted = last is None or t - last >= self.gap
            last = t if accepted else last
            yield Row(user_id=key[0], event_id=event_id, t=t, accepted=accepted)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.last.update((last,))
            self.handle.registerTimer(self._ends(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _ends(self, t: int) -> int:
        return -(-(t + self.gap) // 1000)  # timers count milliseconds


def limited(events: DataFrame, gap: int, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, t, accepted) for a stream of events (user_id, event_id, ts); rejected calls don't move the clock.

    A call more than `late` behind the latest one seen may be left out, as the watermark has passed it; one that is only older than the last
    accepted one is rejected.  Of a micro-batch a user's times and ids are put in order, so its files bound the memory
    (maxFilesPerTrigger); a user's state goes once the watermark makes it needless.  Calls without a time or user are no calls.
    """
    keep_state_in_rocksdb(events.sparkSession)
    calls = events.where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    calls = calls.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("t"))
    return calls.groupBy("user_id").transformWithState(statefulProcessor=Limiter(gap), outputStructType=_OUT, outputMode="append", timeMode="EventTime")
