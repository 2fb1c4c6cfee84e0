"""Streams in several batches, stopped and started again, against what a batch gives."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.streaming.answers import Assembler, assembled
from quern.streaming.rate_limit import limited
from quern.streaming.upsert import latest, retry, upserts

HOUR = 3600 * 1_000_000
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


class Feed:
    """A folder that gets one file after another, and a stream over it that is run to its end and stopped each time."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n = spark, str(path), schema, make, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        writer = self.make(stream).writeStream.format("parquet").option("path", f"{self.path}/rows").option("checkpointLocation", f"{self.path}/state")
        q = writer.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress

    def rows(self):
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/rows").collect()]


def fold(calls, gap):
    last, out = {}, {}
    for user, event, t in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        ok = user not in last or t - last[user] >= gap
        if ok:
            last[user] = t
        out[event] = ok
    return out


def test_limiter_over_restarts_drops_late_calls_and_forgets_users(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, event_id long, ts timestamp", lambda s: limited(s, 6 * HOUR, "1 hour"))
    r, sent, event, left = random.Random(1), [], 0, []
    for day in range(4):
        rows = []
        for _ in range(40):
            at = START + timedelta(days=day, minutes=r.randint(0, 1439))
            # users of one day do not call on the next ones
            rows.append((10 * day + r.randint(0, 4), event, at))
            event += 1
        feed.add(rows)
        sent += rows
        left.append(feed.run()[-1]["stateOperators"][0]["numRowsTotal"])
    feed.add([(0, event, START)])  # four days late
    feed.add([(99, event + 1, START + timedelta(days=9))])
    left.append(feed.run()[-1]["stateOperators"][0]["numRowsTotal"])
    sent.append((99, event + 1, START + timedelta(days=9)))
    want = fold([(u, e, round((t - START).total_seconds() * 1e6)) for u, e, t in sent], 6 * HOUR)
    got = {e: ok for _, e, _, ok in feed.rows()}
    assert got == want  # the late call is in neither
    assert max(left) > left[-1]


def test_upserts_survive_a_crash_and_try_failures_again(spark, tmp_path):
    path, schema = str(tmp_path), "k long, v long, t long"
    for i in range(4):
        spark.createDataFrame([(k, 10 * i + k, i) for k in range(5)], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    crash = {"armed": True}

    def work(rows):
        if crash["armed"] and rows.where("t >= 2").limit(1).count():
            raise RuntimeError("lost")
        return rows.withColumn("ok", (F.col("k") != 3) | (F.col("attempt") > 1))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        return upserts(stream, f"{path}/out", work).trigger(availableNow=True).start()

    stopped = run()
    with pytest.raises(Exception, match="lost"):
        stopped.awaitTermination()
    crash["armed"] = False
    q = run()
    q.awaitTermination()
    batch, tried = q.lastProgress["batchId"], spark.createDataFrame([], schema + ", attempt int").schema
    while (then := retry(spark, f"{path}/out", tried, work, batch)) > batch:
        batch = then
    rows = spark.read.parquet(f"{path}/out/rows")
    assert rows.count() == 20 and rows.select("k", "t").distinct().count() == 20
    got = latest(spark, f"{path}/out", tried, ["k"], ["t"]).collect()
    assert sorted((r["k"], r["t"], r["v"]) for r in got) == [(k, 3, 30 + k) for k in range(5)]
    assert {r["attempt"] for r in got if r["k"] == 3} == {2}


def test_answers_of_split_tokens_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "conv_id long, turn long, i long, token string, last boolean, ts timestamp", lambda s: assembled(s))
    whole = {(1, 1): "why [1] <think </think>Because [2], [2]. </think> stays", (1, 2): "no separator at all", (2, 1): "</think>", (3, 1): "lost</think>never ends"}
    tokens = []
    for (c, t), text in whole.items():
        parts = [text[i : i + 5] for i in range(0, len(text), 5)]
        tokens += [(c, t, i, p, i + 1 == len(parts) and c != 3, START + timedelta(seconds=i)) for i, p in enumerate(parts)]
    random.Random(2).shuffle(tokens)
    for a in range(0, len(tokens), 8):
        feed.add(tokens[a : a + 8])
        feed.run()
    feed.add([(9, 1, 0, "</think>x", True, START + timedelta(days=1))])
    feed.run()
    feed.add([(9, 2, 0, "</think>y", True, START + timedelta(days=1))])
    feed.run()
    ends = {(c, t): (kind, text) for c, t, kind, text in feed.rows() if kind != "delta"}
    assert ends == {(1, 1): ("answer", "Because [2], [2]. </think> stays"), (1, 2): ("unseparated", ""), (2, 1): ("answer", ""), (3, 1): ("broken", "never ends"), (9, 1): ("answer", "x"), (9, 2): ("answer", "y")}
    deltas = [text for c, t, kind, text in feed.rows() if kind == "delta" and (c, t) == (1, 1)]
    assert sum(map(len, deltas)) == len("Because [2], [2]. </think> stays") and all(x in whole[1, 1].split("</think>", 1)[1] for x in deltas)


class Counted:
    """A state of any kind that counts the calls to it."""

    def __init__(self):
        self.calls, self.value, self.items, self.keyed = 0, None, [], {}

    def __getattribute__(self, name):
        if name in ("get", "update", "appendValue", "clear", "exists", "containsKey", "updateValue", "getValue", "removeKey"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(list(self.items)) if self.items else self.value if self.value is not None else self.empty

    def update(self, value):
        self.value = value

    def appendValue(self, value):
        self.items.append(value)

    def containsKey(self, key):
        return key in self.keyed

    def updateValue(self, key, value):
        self.keyed[key] = value

    def getValue(self, key):
        return self.keyed[key]

    def removeKey(self, key):
        del self.keyed[key]

    def clear(self):
        self.value, self.items, self.keyed = None, [], {}


class Handle:
    def __init__(self):
        self.states = []

    def state(self, empty):
        made = Counted()
        made.empty = empty
        self.states.append(made)
        return made

    def getValueState(self, name, schema):
        return self.state(None)

    def getListState(self, name, schema):
        return self.state(())

    def getMapState(self, name, *schemas):
        return self.state(())

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def test_calls_to_the_state_go_by_batches_and_not_by_tokens():
    text = "thought</think>" + "".join(f"word{i} " for i in range(700))
    tokens = [Row(i=i, token=text[7 * i : 7 * i + 7], last=7 * i + 7 >= len(text), ts=START) for i in range(-(-len(text) // 7))]
    order = list(range(len(tokens)))
    random.Random(5).shuffle(order)
    handle, one = Handle(), Assembler("</think>", 1000)
    one.init(handle)
    out = []
    for a in range(0, len(tokens), 250):
        out += one.handleInputRows((1, 2), iter([tokens[i] for i in order[a : a + 250]]), None)
    assert [r["text"] for r in out if r["kind"] == "answer"] == [text.split("</think>", 1)[1]]
    assert "".join(r["text"] for r in out if r["kind"] == "delta") == text.split("</think>", 1)[1]
    assert sum(s.calls for s in handle.states) <= 8 * -(-len(tokens) // 250)
