"""The rate limiter over a table: one accepted call in a span of time for each user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folded(gap: int):
    """From calls (user, t) by user and time: (user_id, calls, accepted, last_accepted), one row for each user."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, calls, accepted, last, some = None, 0, 0, None, False

        def row() -> list[tuple]:
            return [(user, calls, accepted, last)] if some else []

        for batch in batches:
            out: list[tuple] = []
            users, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            starts = [i for i in range(len(users)) if not i or users[i] != users[i - 1]]
            for a, z in zip(starts, [*starts[1:], len(users)], strict=True):
                if not some or users[a] != user:
                    out += row()
                    user, calls, accepted, last, some = users[a], 0, 0, None, True
                part = times[a:z]
                calls += z - a
                i = 0 if last is None else int(np.searchsorted(part, last + gap))
                while i < len(part):  # from each accepted call straight to the next one
                    accepted, last = accepted + 1, int(part[i])
                    i = int(np.searchsorted(part, last + gap))
            yield _rows(out)
        yield _rows(row())

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["user_id", "calls", "accepted", "last_accepted"])


def accepted_calls(events: DataFrame, gap: int, user: str = "user_id", time: str = "t") -> DataFrame:
    """(user_id, calls, accepted, last_accepted): a call counts if `gap` has passed since the last one that did.

    A user's calls pass one task in the order of time (sorted there, with spilling), which keeps three numbers of them and no list.
    """
    calls = events.select(F.col(user).cast("long").alias("user_id"), F.col(time).cast("long").alias("t")).where("t is not null")
    return calls.repartition("user_id").sortWithinPartitions("user_id", "t").mapInArrow(_folded(gap), "user_id long, calls long, accepted long, last_accepted long")
