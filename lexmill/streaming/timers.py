"""Keyed state with timers: session memories that are cleared when idle, event feeds with heartbeats, a cache that expires.

Each client, corpus or key has a state of its own, which an event-time timer drops, so state stays in proportion to what is
active. Rows behind the watermark are left out. The session must use the RocksDB state store (``build_session`` does).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

# Messages of a memory, characters of an assistant's message in it, seconds to a heartbeat and of a cached value.
HISTORY, ASSISTANT_CHARS, HEARTBEAT, CACHED = 12, 500, 30, 300


def _rows(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class _Timed(StatefulProcessor):
    """One value for each key and one timer, which is moved when the key is seen again."""

    schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def alarm(self, at_ms: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


class Memory(_Timed):
    schema = "turns array<bigint>, lines array<string>, last bigint"

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def handleInputRows(self, key, rows, timerValues):
        turns, lines, last = ([], [], 0) if not self.value.exists() else (list(self.value.get()[0]), list(self.value.get()[1]), self.value.get()[2])
        new = _rows(rows, ["turn"])
        last = max(last, int(new["at"].max()))
        latest = sorted(zip(turns + new["turn"].tolist(), lines + new["line"].tolist()))[-HISTORY:]
        turns, lines = [int(t) for t, _ in latest], [x for _, x in latest]
        self.value.update((turns, lines, last))
        self.alarm(last + self.idle)
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [turns[-1]], "history": [lines], "cleared": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        turns = list(self.value.get()[0])
        self.value.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [turns[-1]], "history": [[]], "cleared": [True]})


def session_memory(messages: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(conv_id, turn, history, cleared) of ``messages(conv_id, turn, role, text, ts)``: the latest 12 messages after each batch.

    Assistants' messages are cut to 500 characters and marked. A conversation without a message for ``idle`` of event time
    is cleared, with a row that says so, and starts anew with its next message.
    """
    ship(messages.sparkSession)
    text = F.coalesce("text", F.lit(""))
    long = (F.col("role") == "assistant") & (F.length(text) > ASSISTANT_CHARS)
    cut = F.when(long, F.concat(F.left(text, F.lit(ASSISTANT_CHARS)), F.lit("..."))).otherwise(text)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), cut)
    shown = messages.withWatermark("ts", late).select("conv_id", F.col("turn").cast("long").alias("turn"), line.alias("line"), "ts", F.unix_millis("ts").alias("at"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return shown.groupBy("conv_id").transformWithStateInPandas(Memory(idle_ms), "conv_id long, turn long, history array<string>, cleared boolean", "Update", "EventTime")


class Feed(_Timed):
    schema = "last bigint, seq bigint"

    def __init__(self, every_ms: int, end: str):
        self.every, self.end = every_ms, end

    def handleInputRows(self, key, rows, timerValues):
        last, seq = self.value.get() if self.value.exists() else (0, 0)
        new = _rows(rows, ["at", "seq"])
        ended = new["event"].eq(self.end)
        if ended.any():
            new = new.iloc[: int(ended.to_numpy().argmax()) + 1]  # what comes behind the end is not told
        out = pd.DataFrame({"corpus": key[0], "n": range(int(seq) + 1, int(seq) + 1 + len(new)), "at": new["at"].tolist(), "event": new["event"].tolist(), "data": new["data"].tolist()})
        if ended.any():
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.value.clear()
        else:
            last = max(int(last), int(new["at"].max()))
            self.value.update((last, int(seq) + len(new)))
            self.alarm(last + self.every)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, seq = self.value.get()
        beats = max(1, (timerValues.getCurrentWatermarkInMs() - int(last)) // self.every)  # as many as were due
        at = [int(last) + self.every * (i + 1) for i in range(beats)]
        self.value.update((at[-1], int(seq) + beats))
        self.alarm(at[-1] + self.every)
        yield pd.DataFrame({"corpus": key[0], "n": range(int(seq) + 1, int(seq) + 1 + beats), "at": at, "event": "heartbeat", "data": ""})


def event_feed(events: DataFrame, every: int = HEARTBEAT, end: str = "done", late: str = "0 seconds") -> DataFrame:
    """(corpus, n, at, event, data) of ``events(corpus, seq, event, data, ts)``: each corpus' events in order, numbered.

    A corpus that tells nothing for ``every`` seconds of event time tells a heartbeat, and one more for each that was due.
    The event ``end`` closes it: its state and its timer go.
    """
    ship(events.sparkSession)
    shown = events.withWatermark("ts", late).select("corpus", "seq", "event", "data", "ts", F.unix_millis("ts").alias("at"))
    return shown.groupBy("corpus").transformWithStateInPandas(Feed(every * 1000, end), "corpus string, n long, at long, event string, data string", "Append", "EventTime")


class Cache(_Timed):
    schema = "held string, since bigint"

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def handleInputRows(self, key, rows, timerValues):
        held, since = self.value.get() if self.value.exists() else (None, None)
        new = _rows(rows, ["at", "request_id"])
        out = []
        for request, value, at in zip(new["request_id"], new["value"], new["at"]):
            hit = since is not None and at - since < self.ttl
            if not hit:
                held, since = value, int(at)
            out.append((request, held, hit))
        self.value.update((held, int(since)))
        self.alarm(int(since) + self.ttl)
        yield pd.DataFrame({"key": key[0], "request_id": [r for r, _, _ in out], "value": [v for _, v, _ in out], "hit": [h for _, _, h in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.value.clear()
        yield pd.DataFrame({"key": [], "request_id": [], "value": [], "hit": []}).astype({"key": str, "request_id": "int64", "value": str, "hit": bool})


def cached(requests: DataFrame, ttl: int = CACHED, late: str = "10 minutes") -> DataFrame:
    """(key, request_id, value, hit) of ``requests(key, request_id, value, ts)``: a value serves ``ttl`` seconds from when it was taken.

    The first request of a key, or the first after its value expired, takes its own ``value``; others are hits and get
    the one that is held.
    """
    ship(requests.sparkSession)
    shown = requests.withWatermark("ts", late).select("key", "request_id", "value", "ts", F.unix_millis("ts").alias("at"))
    return shown.groupBy("key").transformWithStateInPandas(Cache(ttl * 1000), "key string, request_id long, value string, hit boolean", "Append", "EventTime")
