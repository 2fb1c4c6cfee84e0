"""Answers put together from a stream of tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.state import keep_state_in_rocksdb

SEPARATOR = "</think>"
_OUT = "conv_id long, turn long, kind string, text string"


class Assembler(StatefulProcessor):
    """Keeps, before the separator, only what may be the beginning of it; after it, the answer so far, for the end; and tokens that came too early.

    Tokens of a micro-batch are put together before the state is touched, so calls to it go by answers and batches and not by tokens; those
    that came too early are kept in one piece a batch, and read again only when the gap before the first of them is closed.
    """

    def __init__(self, separator: str, wait: int):
        self.separator, self.wait = separator, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "answering boolean, tail string, next int, size int, timer long, first int")
        self.parts = handle.getListState("parts", "text string")
        self.early = handle.getListState("early", "tokens string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        row = lambda kind, text: Row(conv_id=key[0], turn=key[1], kind=kind, text=text)
        known = self.at.get()
        answering, tail, at, size, timer, first = known or (False, "", 0, -1, 0, -1)
        latest, new = 0, {}
        for r in rows:
            latest, size = max(latest, int(r["ts"].timestamp() * 1000)), r["i"] + 1 if r["last"] else size
            if r["i"] >= at:  # one that is known already is no news
                new[r["i"]] = r["token"] or ""
        run, waits = [], first >= 0
        while at in new or (waits and first <= at):
            if at in new:
                run.append(new.pop(at))
                at += 1
            else:
                new = {i: t for some in self.early.get() for i, t in json.loads(some[0]) if i >= at} | new
                self.early.clear()
                waits = False
        text = "".join(run)
        if not answering:
            thought = tail + text
            cut = thought.find(self.separator)
            answering = cut >= 0
            text = thought[cut + len(self.separator) :] if answering else ""
            tail = "" if answering else thought[-len(self.separator) + 1 :]
        if text:
            yield row("delta", text)
        if at == size:
            yield row("answer" if answering else "unseparated", "".join(p[0] for p in self.parts.get()) + text if known else text)
            if known:
                self.handle.deleteTimer(timer)
                self._forget()
            return
        if text:
            self.parts.appendValue((text,))
        left = sorted((i, t) for i, t in new.items() if i > at)
        if left:
            self.early.appendValue((json.dumps(left),))
        first = min([*([first] if waits else []), *(i for i, _ in left)], default=-1)
        ends = latest + self.wait
        if known and timer != ends:
            self.handle.deleteTimer(timer)
        if not known or timer != ends:
            self.handle.registerTimer(ends)
        self.at.update((answering, tail, at, size, ends, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(conv_id=key[0], turn=key[1], kind="broken", text="".join(p[0] for p in self.parts.get()))
        self._forget()

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        self.at.clear()
        self.parts.clear()
        self.early.clear()


def assembled(tokens: DataFrame, separator: str = SEPARATOR, wait: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """(conv_id, turn, kind, text) for a stream of tokens (conv_id, turn, i, token, last, ts).

    Text is sent on as it comes (`delta`, one row of a micro-batch), but only what follows the separator, which may be split between tokens; when the last token is in, the whole
    answer follows (`answer`), or nothing if no separator came (`unseparated`).  Tokens are numbered from 0 and taken by number; one that comes before those ahead of it waits.  An answer
    whose last token does not come within `wait` of the watermark is sent as `broken` and forgotten.
    """
    keep_state_in_rocksdb(tokens.sparkSession)
    timed = tokens.withWatermark("ts", wait)
    return timed.groupBy("conv_id", "turn").transformWithState(statefulProcessor=Assembler(separator, wait_ms), outputStructType=_OUT, outputMode="append", timeMode="EventTime")
