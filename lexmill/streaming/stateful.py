"""Structured Streaming twins: windowed counts, sessions, rate limits and ratings."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import arena
from ..session import ship


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a Parquet folder or file as a stream with an event-time column."""
    schema = spark.read.parquet(path).schema
    if path.endswith(".parquet") and "/" in path:
        folder, name = path.rsplit("/", 1)
        reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
        stream = reader.parquet(folder)
    else:
        stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_limited(events: DataFrame, limit: int = 60, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(client, event_id, allowed): admitted times inside the window are a client's state, dropped when
    event time has passed its last window."""
    ship(events.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        flags = []
        for t in rows["at"]:
            times = [x for x in times if t - x < seconds * 1_000_000]
            flags.append(len(times) < limit)
            if flags[-1]:
                times.append(int(t))
        state.update((times,))
        last = int(rows["at"].max()) // 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"], "allowed": flags})

    keyed = events.withWatermark("ts", late).select(F.col("user_id").alias("client"), "event_id", "ts", F.unix_micros("ts").alias("at"))
    return keyed.groupBy("client").applyInPandasWithState(
        run, "client long, event_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def session_counts(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """Idle sessions of each user; events later than the watermark are dropped."""
    window = F.session_window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count(F.lit(1)).alias("events"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"))


def elo_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ratings after each batch of votes; a repeated match id counts once. Ratings couple all keys: one state."""
    ship(events.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rating = dict(zip(*state.get)) if state.exists else {}
        votes = pd.concat(list(frames)).sort_values(["ts", "match_id"])
        for a, b, w in zip(votes["strategy_a"], votes["strategy_b"], votes["winner"]):
            arena.rate(rating, a, b, w)
        state.update((list(rating), list(rating.values())))
        yield pd.DataFrame({"strategy": list(rating), "rating": [round(v, 6) for v in rating.values()]})

    votes = arena.votes(events.withWatermark("ts", late)).dropDuplicatesWithinWatermark(["match_id"])
    return votes.withColumn("all", F.lit(0)).groupBy("all").applyInPandasWithState(
        run, "strategy string, rating double", "names array<string>, ratings array<double>", "update", GroupStateTimeout.NoTimeout
    )


# Messages of a history, and characters of an assistant's message in it.
HISTORY, ASSISTANT_CHARS = 12, 500


def session_history(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, history): each conversation's latest 12 messages after each batch of ``messages(conv_id, turn, role, text)``.

    Assistants' messages are cut to 500 characters and marked; rows without a text count as empty ones.
    """
    ship(messages.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, lines = map(list, state.get) if state.exists else ([], [])
        for frame in frames:
            turns += frame["turn"].tolist()
            lines += (frame["role"] + ": " + frame["text"]).tolist()
            latest = sorted(zip(turns, lines))[-HISTORY:]
            turns, lines = [int(t) for t, _ in latest], [x for _, x in latest]
        state.update((turns, lines))
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [turns[-1]], "history": [lines]})

    text = F.coalesce("text", F.lit(""))
    long = (F.col("role") == "assistant") & (F.length(text) > ASSISTANT_CHARS)
    cut = F.when(long, F.concat(F.left(text, F.lit(ASSISTANT_CHARS)), F.lit("..."))).otherwise(text)
    shown = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), cut.alias("text"))
    return shown.groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, turn long, history array<string>", "turns array<long>, lines array<string>", "update", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    name = "drained_" + Path(folder).name.replace("-", "_")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
