"""Chat memory, idle sessions and rate limits, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def memory(turns: DataFrame, last: int = 12, clip: int = 500) -> DataFrame:
    """The last messages of each conversation; long assistant texts are cut and marked."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    long = (F.col("role") == "assistant") & (F.length("text") > clip)
    content = F.when(long, F.concat(F.substring("text", 1, clip), F.lit("..."))).otherwise(F.col("text"))
    return turns.withColumn("back", back).filter(F.col("back") <= last).select("conv_id", "turn", "role", content.alias("content"))


def idle_sessions(events: DataFrame, key: str = "user_id", minutes: int = 30) -> DataFrame:
    """Sessions that end after ``minutes`` without an event."""
    window = F.session_window(F.col("ts").cast("timestamp"), f"{minutes} minutes")
    return events.groupBy(key, window.alias("session")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session")


def requests_in_window(events: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """How many requests of the same client came in the ``seconds`` up to each request."""
    over = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(over))


def admitted(events: DataFrame, key: str = "user_id", limit: int = 60, seconds: int = 60) -> DataFrame:
    """The exact limiter: rejected requests leave no trace. A fold in time order for each client.

    Rows of a client stream through one task in order; only the admitted times inside the window are held.
    """
    from collections import deque

    import pyarrow as pa

    def fold(batches):
        client, times = None, deque()
        for batch in batches:
            flags = []
            for k, t in zip(batch.column("client").to_pylist(), batch.column("at").to_pylist()):
                if k != client:
                    client, times = k, deque()
                while times and t - times[0] >= seconds * 1_000_000:
                    times.popleft()
                flags.append(len(times) < limit)
                if flags[-1]:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("client"), pa.array(flags, pa.bool_())], ["event_id", key, "allowed"])

    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.col(key).cast("long").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = rows.repartition("client").sortWithinPartitions("client", "at", "event_id")
    return ordered.mapInArrow(fold, f"event_id long, {key} long, allowed boolean")
